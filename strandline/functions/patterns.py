"""Pattern banks of the query features.

Fixed values: all patterns, word lists, templates and scores of this module are given, in their order; results depend on
them. Everything that uses them takes a bank as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

GRAPH_KEYWORDS = (
    "điều kiện", "trường hợp", "trừ khi", "ngoại trừ", "được quy định tại", "theo quy định tại", "căn cứ vào", "dẫn chiếu",
    "áp dụng.*điều", "thực hiện theo", "hướng dẫn tại", "liên quan đến.*điều", "quy định tại khoản", "quy định tại điểm",
    "quy định tại điều",
)
CROSS_DOC = (
    "đồng thời", "bên cạnh đó", "ngoài ra", "trong khi đó", r"\d+/\d{4}/[A-ZĐ\-]+.*và.*\d+/\d{4}/[A-ZĐ\-]+",
    "nghị định.*và.*thông tư", "luật.*và.*nghị định", "quyết định.*và.*nghị định", "thông tư.*và.*luật", "chỉ thị.*và.*nghị định",
)
LEGAL_REFS = (
    r"\d+/\d{4}/[A-ZĐ\-]{2,}", r"\d+/[A-ZĐ\-]{2,}-[A-ZĐ]+", r"\d+/[A-ZĐ\-]{2,}", r"[Nn]ghị\s+định\s+(?:số\s+)?\d+",
    r"[Tt]hông\s+tư\s+(?:số\s+)?\d+", r"[Qq]uyết\s+định\s+(?:số\s+)?\d+", r"[Ll]uật\s+[A-ZĐÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬ]", r"[Cc]hỉ\s+thị\s+(?:số\s+)?\d+",
)
ARTICLE_REF = r"[Ðđ]i[eềèé]\s*u\s+\d+"
YES_NO = (
    r"\bcó\b.{1,60}\bkhông\b", r"\bliệu\b.{1,60}\bkhông\b", r"\bđúng\b.{0,20}\bkhông\b", r"\bsai\b.{0,20}\bkhông\b",
    r"\bđược\b.{0,40}\bhay\s+không\b", r"\bphải\b.{0,40}\bhay\s+không\b", r"\bcó\s+thể\b.{0,40}\bkhông\b", r"\bcó\s+được\b.{0,40}\bkhông\b",
    r"\bnhư\s+vậy\b.{0,50}\bkhông\b", r"\bviệc.{0,40}\bcó\b.{0,30}\bkhông\b",
)
FACTOID = (
    r"^[Aa]i\b", r"^[Cc]ái\s+gì\b", r"^[Gg]ì\b", r"\blà\s+gì\b", r"\bđược\s+định\s+nghĩa\b", r"\bkhái\s+niệm\b", r"\bý\s+nghĩa\b",
    r"\bđịnh\s+nghĩa\b", r"^[Nn]hững?\s+", r"^[Cc]ác\s+", r"\btên\s+g[oọ]i\b", r"\bký\s+hiệu\b", r"\bthuộc\s+loại\b", r"\bbao\s+nhiêu\b",
    r"\bmức\s+phạt\b", r"\bmức\s+xử\s+phạt\b", r"\bphạt\s+bao\s+nhiêu\b", r"\bthời\s+hạn\b", r"\bthời\s+gian\b", r"\bbao\s+lâu\b",
)
AMBIGUITY = (r"\bkhông\s+rõ\b", r"\bchưa\s+rõ\b", r"\bý\s+kiến\b", r"\btheo\s+bạn\b", r"\btheo\s+ý\s+kiến\b", r"\bgiải\s+thích\s+giúp\b", r"\bcó\s+nghĩa\s+là\s+gì\b")
STRUCTURE = {
    "has_conditional_structure": r"\b(nếu|khi|trường\s+hợp|trong\s+trường\s+hợp|giả\s+sử|giả\s+định)\b",
    "has_negation": r"\b(không|chưa|chẳng|chẳng\s+phải|không\s+phải|không\s+được)\b",
    "has_comparison": r"\b(so\s+với|khác\s+biệt|hơn|tương\s+tự|giống|khác\s+nhau|phân\s+biệt)\b",
    "has_enumeration": r"\b(liệt\s+kê|bao\s+gồm|gồm\s+có|bao\s+gồm\s+những|các\s+trường\s+hợp)\b",
    "has_procedure_marker": r"\b(thủ\s+tục|quy\s+trình|các\s+bước|hướng\s+dẫn|quy\s+định\s+về\s+việc|trình\s+tự|quy\s+trình\s+thực\s+hiện)\b",
    "has_multi_hop_connector": r"(điều\s+\d+.{0,20}(?:và|hoặc|cùng\s+với).{0,20}điều\s+\d+|\d+/\d{4}/.{0,10}(?:và|hoặc).{0,10}\d+/\d{4}/)",
}


@dataclass(frozen=True)
class Lexical:
    """The bank of the 16 lexical features."""

    graph_keywords: tuple = GRAPH_KEYWORDS
    cross_doc: tuple = CROSS_DOC
    legal_refs: tuple = LEGAL_REFS
    article_ref: str = ARTICLE_REF
    yes_no: tuple = YES_NO
    factoid: tuple = FACTOID
    ambiguity: tuple = AMBIGUITY
    structure: dict = field(default_factory=lambda: dict(STRUCTURE))


@dataclass(frozen=True)
class Complexity:
    """The bank of the complexity features. The last three count for Vietnamese only."""

    sub_question: str
    conditional: str
    article: str
    law_name: str
    multi_hop: str
    comparative: str
    factoid: str
    authority: str
    effect: str
    strong_effect: str
    procedural: str
    relation: str
    effective_date: str
    organisation: str | None = None
    quantity: str | None = None
    finance: str | None = None
    entity: str = r"(?:công ty|doanh nghiệp|cơ quan|tổ chức|cá nhân|người|bên|chủ thể)"


VI = Complexity(
    sub_question=r"(?:thứ nhất|thứ hai|thứ ba|một là|hai là|ba là|đồng thời|ngoài ra|bên cạnh đó)",
    conditional=r"(?:nếu|trong trường hợp|khi|giả sử|trừ khi|trừ trường hợp|điều kiện|theo điều kiện|tùy thuộc|tùy theo|phụ thuộc)",
    article=r"Điều\s+\d+[a-zA-Z]?",
    law_name=r"(?:Luật|Nghị định|Thông tư|Quyết định)\s+\S+",
    multi_hop=r"(?:dẫn chiếu|tham chiếu|căn cứ.*và|liên quan.*đến|ảnh hưởng.*đến|kết hợp.*với|phối hợp.*với|theo.*và.*theo)",
    comparative=r"(?:so sánh|khác nhau.*như thế nào|giữa.*và.*khác|ưu điểm|nhược điểm|điểm khác biệt|mức độ.*hơn)",
    factoid=r"(?:bao\s+nhiêu|mức\s+phạt|mức\s+xử\s+phạt|phạt\s+bao\s+nhiêu|bao\s+nhiêu\s+tiền|là\s+gì|như\s+thế\s+nào|gồm\s+những\s+gì|bao\s+gồm|thời\s+hạn|thời\s+gian|khi\s+nào|ngày\s+nào|tối\s+đa|tối\s+thiểu|bao\s+lâu|có\s+được\s+không|ai\s+được|tại\s+sao|khái\s+niệm|thuật\s+ngữ)",
    authority=r"(?:thẩm\s+quyền|có\s+quyền|được\s+quyền|chịu\s+trách\s+nhiệm|cấp\s+trên|cấp\s+dưới|cơ\s+quan\s+chủ\s+quản|cơ\s+quan\s+có\s+thẩm\s+quyền|người\s+có\s+thẩm\s+quyền|ai\s+được\s+phép|ai\s+có\s+quyền)",
    effect=r"(?:bãi\s+bỏ|thay\s+thế|sửa\s+đổi|bổ\s+sung|không\s+còn\s+hiệu\s+lực|hết\s+hiệu\s+lực|có\s+hiệu\s+lực|được\s+áp\s+dụng\s+thay|quy\s+định\s+cũ|quy\s+định\s+mới|chuyển\s+tiếp|điều\s+khoản\s+chuyển\s+tiếp)",
    strong_effect=r"(?:bãi\s+bỏ|thay\s+thế|sửa\s+đổi|bổ\s+sung|không\s+còn\s+hiệu\s+lực|hết\s+hiệu\s+lực|được\s+áp\s+dụng\s+thay|quy\s+định\s+cũ|quy\s+định\s+mới|chuyển\s+tiếp|điều\s+khoản\s+chuyển\s+tiếp)",
    procedural=r"(?:quy\s+trình|thủ\s+tục|các\s+bước|bước\s+thứ|trình\s+tự|nộp\s+hồ\s+sơ|xét\s+duyệt|phê\s+duyệt|ban\s+hành|sau\s+khi|trước\s+khi.*thì|phải.*mới\s+được|điều\s+kiện\s+để\s+được)",
    relation=r"(?:giữa\s+\S+\s+và\s+\S+|mối\s+quan\s+hệ|quyền\s+và\s+nghĩa\s+vụ|trách\s+nhiệm\s+của.*và.*của|cả.*lẫn|vừa.*vừa)",
    effective_date=r"(?:khi\s+nào.*(?:có\s+hiệu\s+lực|hiệu\s+lực\s+thi\s+hành)|(?:có\s+hiệu\s+lực|hiệu\s+lực\s+thi\s+hành).*(?:từ\s+ngày\s+nào|khi\s+nào))",
    organisation=r"(?:tư\s+cách\s+pháp\s+nhân|đơn\s+vị\s+trực\s+thuộc|thành\s+lập|tổ\s+chức\s+lại|giải\s+thể|cơ\s+cấu\s+tổ\s+chức|chức\s+năng\s+nhiệm\s+vụ|vị\s+trí\s+pháp\s+lý|nhiệm\s+vụ\s+và\s+quyền\s+hạn)",
    quantity=r"(?:định\s+mức|mức\s+sử\s+dụng|số\s+lượng|bao\s+nhiêu|cần\s+bao\s+nhiêu|diện\s+tích|tỷ\s+lệ|tỉ\s+lệ|ha\b|1/\d+|ngưỡng|mức\s+tối\s+đa|mức\s+tối\s+thiểu)",
    finance=r"(?:vốn\s+ODA|vốn\s+vay\s+ưu\s+đãi|nguồn\s+vốn|sử\s+dụng\s+vốn|dự\s+án|kế\s+hoạch\s+chuyển\s+đổi\s+số|đề\s+án|kinh\s+phí|ngân\s+sách|được\s+phép\s+.*vốn|có\s+được\s+phép\s+.*(?:vốn|kinh\s+phí|ngân\s+sách))",
)
EN = Complexity(
    sub_question=r"(?:\band\b|\bboth\b|\balso\b|\bfirst\b|\bsecond\b|\bthen\b|\bafter\b|\bbefore\b)",
    conditional=r"(?:\bif\b|\bwhen\b|\bunless\b|\bprovided that\b|\bdepending on\b)",
    article=r"(?:Article\s+\d+[a-zA-Z]?|Section\s+\d+[a-zA-Z]?)",
    law_name=r"(?:Law|Act|Code|Regulation|Decree)\s+[A-Z][A-Za-z0-9\- ]{2,80}",
    multi_hop=r"(?:born in|located in|founded by|directed by|written by|starring|same nationality|same country|same place|part of|member of|father of|mother of|spouse of|capital of|held by|portrayed by)",
    comparative=r"(?:\bsame\b|\bdifferent\b|\bcompare\b|\bversus\b|\bvs\.?\b|\bolder\b|\byounger\b|\blarger\b|\bsmaller\b)",
    factoid=r"(?:\bwhat is\b|\bwho is\b|\bwhen was\b|\bwhere is\b|\bhow many\b|\bhow long\b)",
    authority=r"(?:authority|jurisdiction|responsible for|authorized to|who has the right|who is allowed|chain of command)",
    effect=r"(?:repeal|replace|amend|supersede|no longer in effect|come into force|transitional provision|prior law)",
    strong_effect=r"(?:repeal|replace|amend|supersede|no longer in effect|transitional provision|prior law)",
    procedural=r"(?:procedure|process|steps|sequence|before.*can|required to.*before|submit.*then|after approval)",
    relation=r"(?:between.*and|relationship between|rights and obligations|both.*and|responsibility of.*and)",
    effective_date=r"(?:when.*(?:come into force|effective)|(?:come into force|effective).*when)",
)

PRONOUNS = (
    ("ông ấy", r"\bông\s+ấy\b"), ("bà ấy", r"\bbà\s+ấy\b"), ("họ", r"\bhọ\b(?!\s+(?:tên|và))"), ("nó", r"\bnó\b"), ("người đó", r"\bngười\s+đó\b"),
    ("công ty đó", r"\bcông\s+ty\s+(?:đó|này)\b"), ("doanh nghiệp đó", r"\bdoanh\s+nghiệp\s+(?:đó|này)\b"), ("tổ chức đó", r"\btổ\s+chức\s+(?:đó|này)\b"),
    ("cơ quan đó", r"\bcơ\s+quan\s+đó\b"), ("điều đó", r"\bđiều\s+đó\b"), ("luật đó", r"\bluật\s+đó\b"), ("bên đó", r"\bbên\s+đó\b"),
    ("việc đó", r"\bviệc\s+đó\b"), ("trường hợp đó", r"\btrường\s+hợp\s+(?:đó|này)\b"),
)
VAGUE = (
    r"\bquy\s+định\b(?!\s+(?:tại|của|về|số|theo|gì|như|cho|gồm|nào))", r"\bluật\b(?!\s+(?:\w{2,}))", r"\bđiều\s+khoản\b(?!\s+\d)",
    r"\bvăn\s+bản\b(?!\s+(?:số|quy))", r"\bnhư\s+trên\b", r"\bnhư\s+vậy\b", r"\bđã\s+nói\b",
    r"\b(?:vậy|nếu\s+không|trường\s+hợp\s+đó|trường\s+hợp\s+này|có\s+hợp\s+pháp\s+không|có\s+bị\s+xử\s+phạt\s+không)\b",
)
ENTITIES = (
    ("PERSON", r"\b(?:ai|người|ông|bà|cá\s+nhân|công\s+dân)\b"), ("ORGANIZATION", r"\b(?:cơ\s+quan|tổ\s+chức|công\s+ty|doanh\s+nghiệp)\b"),
    ("LEGAL_ARTICLE", r"\b(?:Điều\s+\d+|Khoản\s+\d+|Luật\s+\S+)\b"), ("TIME", r"\b(?:năm\s+\d{4}|tháng\s+\d+|ngày\s+\d+)\b"),
)
NAMED_DOCUMENT = r"(?<!\w)(?:Nghị\s+định|Thông\s+tư|Quyết\s+định|Luật|Bộ\s+luật|Điều\s+\d+|\d+/\d{4}/[A-ZĐ\-]+|\d+/QĐ-[A-ZĐ]+)"
SPECIFIC_ENTITY = r"(?:Điều\s+\d+|Khoản\s+\d+|Luật\s+\S{2,}|Nghị\s+định|Bộ\s+luật)"
GENERIC_NEED = r"(?<!\w)(?:hồ\s+sơ|thủ\s+tục|mức\s+phạt|trách\s+nhiệm|cơ\s+quan|giấy\s+phép|nghĩa\s+vụ|áp\s+dụng|xin\s+phép|luật\s+nào|quy\s+định\s+cũ|chịu\s+trách\s+nhiệm)(?!\w)"
CONCRETE_ANCHOR = r"(?<!\w)(?:xây\s+dựng|kết\s+hôn|đất\s+đai|giao\s+thông|bảo\s+hiểm|môi\s+trường|y\s+tế|hôn\s+nhân|lao\s+động|thuế|ngân\s+sách|chất\s+thải|đường\s+bộ|tàu\s+biển|hàng\s+không)(?!\w)"
BROAD_SUBJECT = r"(?<!\w)(?:doanh\s+nghiệp|cá\s+nhân|công\s+ty|cơ\s+quan\s+nhà\s+nước|ubnd|ủy\s+ban\s+nhân\s+dân|tổ\s+chức\s+nước\s+ngoài|tổ\s+chức)(?!\w)"
BROAD_PREDICATE = r"(?<!\w)(?:có\s+được|có\s+phải|có\s+bị|có\s+thẩm\s+quyền|được\s+hoạt\s+động|bị\s+phạt|được\s+cấp\s+giấy\s+phép|phải\s+lưu\s+trữ)(?!\w)"
DOMAIN_ANCHOR = r"(?<!\w)(?:Nghị\s+định|Thông\s+tư|Quyết\s+định|Luật|Điều\s+\d+|đất\s+đai|xây\s+dựng|môi\s+trường|giao\s+thông|y\s+tế|bảo\s+hiểm|lao\s+động|thuế|ngân\s+sách|hôn\s+nhân)(?!\w)"
COMPARES = r"\b(?:so\s+sánh|khác\s+nhau|giữa)\b"
TOPICS = {
    "ngoại tình": ("ngoại tình", "ngoai tinh", "bồ nhí", "bo nhi", "tuesday"),
    "ly hôn": ("ly hôn", "ly hon", "chia tay", "ly thân", "ly than", "li hon"),
    "tài sản": ("tài sản", "tai san", "nhà đất", "nha dat", "xe cộ", "xe co", "tiền bạc", "tien bac", "chia tai san"),
    "con cái": ("con cái", "con cai", "nuôi con", "nuoi con", "quyền nuôi con", "quyen nuoi con", "trợ cấp", "tro cap"),
    "kết hôn": ("kết hôn", "ket hon", "đăng ký kết hôn", "dang ky ket hon", "lấy nhau", "lay nhau"),
    "lao động": ("lao động", "lao dong", "lương", "luong", "thử việc", "thu viec", "hợp đồng", "hop dong"),
}
CLARIFY = {
    "pronoun": "Bạn có thể cho biết cụ thể {pronoun} là ai/tổ chức nào không?",
    "vague_reference": "Bạn đang đề cập đến quy định/luật cụ thể nào? Vui lòng cung cấp tên hoặc số hiệu văn bản.",
    "missing_entity": "Câu hỏi của bạn thiếu thông tin về {entity_type}. Vui lòng cung cấp thêm chi tiết.",
    "entity_conflict": "Câu hỏi đề cập đến nhiều đối tượng cùng loại. Bạn muốn hỏi về đối tượng nào cụ thể?",
    "multi_interpretation": "Câu hỏi có thể được hiểu theo nhiều cách pháp lý. Bạn vui lòng nêu lĩnh vực, hành vi hoặc văn bản cụ thể.",
    "incomplete_context": "Câu hỏi đang phụ thuộc vào ngữ cảnh trước đó. Bạn vui lòng nêu rõ văn bản, thủ tục hoặc trường hợp cần hỏi.",
    "general": "Câu hỏi của bạn chưa đủ rõ ràng. Vui lòng cung cấp thêm chi tiết để tôi có thể trả lời chính xác hơn.",
}
ENTITY_NAMES = {"PERSON": "người/cá nhân", "ORGANIZATION": "tổ chức/cơ quan", "LEGAL_ARTICLE": "điều luật/văn bản pháp luật", "TIME": "thời gian/năm"}

CONTEXTUAL = (
    (r"(?<!\w)(?:văn\s+bản|nghị\s+định|thông\s+tư|quyết\s+định|luật)\s+(?:đó|này|trên)(?!\w)", ("legal_document",)),
    (r"(?<!\w)(?:điều|điều\s+khoản|quy\s+định|nội\s+dung)\s+(?:đó|này|trên)(?!\w)", ("legal_article", "concept", "legal_document")),
    (r"(?<!\w)(?:thủ\s+tục|hồ\s+sơ)\s+(?:đó|này|trên)(?!\w)", ("procedure",)),
    (r"(?<!\w)cơ\s+quan\s+(?:đó|này)(?!\w)", ("agency",)),
    (r"(?<!\w)(?:trường\s+hợp|việc|nguồn\s+kinh\s+phí|vấn\s+đề)\s+(?:đó|này|trên)(?!\w)", ("factual_situation", "concept", "procedure")),
)
DEMONSTRATIVE = r"(?<!\w)(?:đó|này|trên)(?!\w)"
_DOC = r"\d+\s*/\s*\d{4}\s*/\s*[A-ZĐ]{2,}(?:-[A-ZĐ0-9]+)*|\d+\s*/\s*QĐ-[A-ZĐ]{2,}(?:-[A-ZĐ0-9]+)*|\d+\s*/\s*VBHN-[A-ZĐ]{2,}(?:-[A-ZĐ0-9]+)*"
REFERENTS = (
    ("legal_document", 0.92, rf"(?<!\w)(?:Nghị\s+định|Thông\s+tư|Quyết\s+định|Nghị\s+quyết|Chỉ\s+thị|Pháp\s+lệnh|Văn\s+bản\s+hợp\s+nhất)(?:\s+số)?\s+(?:{_DOC})"),
    ("legal_document", 0.92, rf"(?<!\w)(?:{_DOC})(?!\w)"),
    ("legal_document", 0.92, r"(?<!pháp\s)(?<!\w)(?:Luật|Bộ\s+luật|Hiến\s+pháp)\s+[A-ZĐÀ-Ỹa-zđà-ỹ0-9\s,\-]+?(?:\s+\d{4})?(?=(?:\s+(?:liên\s+quan|về|quy\s+định|được|còn|sửa|và|theo)|[.,;\n]|$))"),
    ("legal_article", 0.9, r"(?<!\w)(?:Điều|Khoản|Điểm)\s+\d+[A-Za-zÀ-ỹ0-9]*(?:\s+(?:Luật|Bộ\s+luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)[^.,;\n]{0,80})?"),
    ("agency", 0.78, r"(?<!\w)(?:Bộ\s+[A-ZĐÀ-Ỹ][^.,;\n]{1,60}|Cục\s+[A-ZĐÀ-Ỹ][^.,;\n]{1,70}|Sở\s+[A-ZĐÀ-Ỹ][^.,;\n]{1,70}|Ủy\s+ban\s+nhân\s+dân[^.,;\n]{0,70}|UBND(?:\s+(?:tỉnh|huyện|xã|thành\s+phố))?(?:\s+[A-ZĐÀ-Ỹ][^.,;\n]{0,40})?)"),
    ("procedure", 0.74, r"(?<!\w)(?:thủ\s+tục|hồ\s+sơ|cấp\s+giấy\s+phép|đổi\s+thẻ|giải\s+quyết\s+hồ\s+sơ)[^.,;\n]{0,90}"),
    ("concept", 0.7, None),
    ("factual_situation", 0.62, r"(?<!\w)(?:trường\s+hợp|tình\s+huống|việc)\s+[^.,;\n]{8,110}"),
)
CONCEPTS = (
    "miễn giảm tiền thuê đất", "miễn, giảm tiền thuê đất", "xử phạt vi phạm hành chính", "quản lý chất thải rắn sinh hoạt",
    "nghĩa vụ tài chính đất đai", "bảo vệ quyền lợi người tiêu dùng", "kinh doanh bảo hiểm", "lưu trữ hồ sơ", "nguồn kinh phí",
    "khám bệnh, chữa bệnh", "thủ tục hành chính",
)
NO_REFERENT = ("không nêu", "chưa nêu", "hỏi chung", "nói chung")

#: Question types, first match wins, over the text in lower case.
QUESTION_TYPES = (
    ("yes_no", (r"có\s+(được|phải|cần|đúng|bắt buộc)", r"(được|có thể)\s+.*\s+không\s*\?", r"có\s+.*\s+hay\s+không", "đúng không", "phải không")),
    ("conditional", (r"nếu\s+.*\s+thì", r"trường\s+hợp\s+.*\s+(thì|sẽ|phải|được)", r"khi\s+nào\s+.*\s+(được|phải|cần)", r"trong\s+trường\s+hợp")),
    ("comparison", (r"(so\s+sánh|khác\s+nhau|giống\s+nhau|sự\s+khác\s+biệt)", r"(khác\s+gì|giống\s+gì)", r"(A\s+và\s+B|giữa\s+.*\s+và\s+)")),
    ("definition", (r"(là\s+gì|được\s+hiểu\s+như\s+thế\s+nào|nghĩa\s+là\s+gì)", r"(định\s+nghĩa|khái\s+niệm|nội\s+dung)")),
    ("procedural", (r"(thủ\s+tục|quy\s+trình|trình\s+tự|các\s+bước|hồ\s+sơ)", r"(cách\s+thức|làm\s+thế\s+nào|như\s+thế\s+nào)")),
)
REASONING = ("nếu", "trường hợp", "khi nào", "có được", "có phải", "được không", "như thế nào")
BAD_ENDINGS = ("(", ",", " và", " hoặc", " gồm", " như", " sau", " của", " về", " theo", " tại", " gồm:", " như:", " sau:")
