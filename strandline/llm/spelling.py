"""Spelling variant grouping: words one insertion, deletion or replacement apart, found by automata over halves of words.

A word is cut into two segments. If two words differ by one code point, the change lies in one segment of either, so the
other segment stands whole at the start or at the end of the other word. Segments are dealt over shards by their hash; a word
can only hold those of at most four (segment, side) pairs, as lengths differ by one at most, and is scanned by the automata
of their shards. A hit counts if the segment stands at its side and the lengths agree; the rest of the two words is then
verified: one by one in small groups, by what is left of the rest without one code point in larger ones.

A segment that more than LIMIT words can hold (counted with partial sums) isn't given to one shard: its words are dealt by
the rest without one code point, so a group has no more words than the alphabet and the length allow.

Defined cases: null texts have no words, a null id reads as the empty string in the hash; repeated rows count as often as
they stand; words of any length are kept whole; ties go to the smaller word in code-point order; an empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

LEAST, TWICE, EVERY, TIMES = 7, 2, 31, 10
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
#: Words that one task counts before it hands its sums on.
HELD = 300_000
#: Rows of one shard, on average; words of one segment from which it is dealt by rests.
SHARD, LIMIT = 50_000, 4096
#: So many segments above LIMIT (some 30 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SEGMENTS = 200_000
#: Groups of more words than FEW are looked up; segments and rests longer than LONG are compared one by one.
FEW, LONG = 8, 64
ROUNDS = 12


def occurrences(doc_id: str, text: str) -> Iterator[str]:
    """The words of a text that can count, changed where the hash says so. doc_id: decimal text."""
    begun = zlib.crc32(f"{doc_id}:".encode())
    for m in _RUN.finditer(text.encode().translate(_LOWER).decode()):
        w = m[0]
        h = zlib.crc32(w.encode(), begun)
        if h % EVERY == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < LEAST:
                continue
        yield w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    sums: dict[str, int] = {}
    for b in batches:
        for doc_id, text in zip(b.column("id"), b.column("text"), strict=True):
            for w in occurrences(doc_id.as_py(), text.as_py()):
                sums[w] = sums.get(w, 0) + 1
            if len(sums) >= HELD:
                yield out()
                sums.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """word, n of the words of docs (doc_id, text) that occur at least twice."""
    common.prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def segments(words: DataFrame) -> DataFrame:
    """One row for each segment that a word has (own) or that words of neighbouring length may share with it."""
    half, odd = F.expr("length(word) div 2"), F.length("word") % 2
    rest = F.length("word") - half
    ends = [(0, F.left("word", half), True), (0, F.left("word", half + F.when(odd == 1, 1).otherwise(-1)), False), (1, F.right("word", rest), True), (1, F.right("word", rest + F.when(odd == 1, -1).otherwise(1)), False)]
    rows = words.withColumn("s", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), seg.alias("seg"), F.lit(own).alias("own")) for side, seg, own in ends))))
    return rows.select("s.side", "s.seg", "s.own", "word", "n")


def near(a: str, b: str) -> bool:
    """Whether the two differ by exactly one code point put in, taken out or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    lo, hi = 0, len(b)  # length of the common beginning
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a[lo + 1 :] == (b[lo + 1 :] if len(a) == len(b) else b[lo:])


class _Group:
    """Words that own one segment at one side, and the search for those whose rest is near another word's rest."""

    def __init__(self, side: int, size: int, owners: list[tuple[str, int]]):
        self.side, self.size, self.one_by_one, self.tails, self.swaps, self.cuts = side, size, [], {}, {}, {}
        for owner in owners:
            t = self.rest(owner[0])
            if len(owners) <= FEW or len(t) > LONG:
                self.one_by_one.append((t, owner))
                continue
            self.tails[t] = owner
            for i in range(len(t)):
                self.swaps.setdefault(chr(i) + t[:i] + t[i + 1 :], []).append(owner)
            for d in {t[:i] + t[i + 1 :] for i in range(len(t))}:
                self.cuts.setdefault(d, []).append(owner)

    def rest(self, word: str) -> str:
        return word[: len(word) - self.size] if self.side else word[self.size :]

    def found(self, word: str) -> Iterator[tuple[str, int]]:
        t = self.rest(word)
        for other, owner in self.one_by_one:
            if near(t, other):
                yield owner
        if self.tails and len(t) <= LONG + 1:
            for i in range(len(t)):
                for owner in self.swaps.get(chr(i) + t[:i] + t[i + 1 :], ()):
                    if owner[0] != word:
                        yield owner
            for d in {t[:i] + t[i + 1 :] for i in range(len(t))}:
                if d in self.tails:
                    yield self.tails[d]
            yield from self.cuts.get(t, ())


class _Sums:
    """Number of near words and the best of them, by word."""

    def __init__(self):
        self.by: dict[str, tuple[int, int, str]] = {}

    def add(self, word: str, owner: str, n: int) -> None:
        count, most, best = self.by.get(word, (0, 0, ""))
        self.by[word] = (count + 1, n, owner) if n > most or n == most and owner < best else (count + 1, most, best)

    def rows(self) -> pa.RecordBatch:
        counts, most, best = zip(*self.by.values(), strict=True) if self.by else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(self.by), pa.string()), pa.array(counts, pa.int64()), pa.array(most, pa.int64()), pa.array(best, pa.string())], ["word", "near", "best_n", "best"])


_FOUND = "word string, near long, best_n long, best string"


def _twice(side: int, word: str, owner: str) -> bool:
    """A pair that shares both segments is found at the start already."""
    return side == 1 and word.startswith(owner[: len(owner) // 2])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: automaton over its segments, every word of the shard scanned once."""
    owners: dict[tuple[int, str], list[tuple[str, int]]] = {}
    scanned: set[str] = set()
    for b in batches:
        for side, seg, own, word, n in zip(*(b.column(c).to_pylist() for c in ("side", "seg", "own", "word", "n")), strict=True):
            scanned.add(word)
            if own:
                owners.setdefault((side, seg), []).append((word, n))
    groups: dict[str, list[_Group]] = {}
    for (side, seg), held in owners.items():
        groups.setdefault(seg, []).append(_Group(side, len(seg), held))
    automaton, sums = ahocorasick.Automaton(), _Sums()
    for seg, held in groups.items():
        if len(seg) <= LONG:
            automaton.add_word(seg, held)
    automaton.make_automaton()
    for word in scanned:
        size = len(word)
        sides = {x for k in {n // 2 for n in (size - 1, size, size + 1)} | {n - n // 2 for n in (size - 1, size, size + 1)} if k > LONG for x in ((k - 1, word[:k]), (size - 1, word[size - k :]))}
        hits = automaton.iter(word) if len(automaton) else ()
        for end, held in chain(hits, ((end, groups[seg]) for end, seg in sides if seg in groups)):
            for g in held:
                if (end == size - 1) if g.side else (end == g.size - 1):
                    for owner, n in g.found(word):
                        if not _twice(g.side, word, owner):
                            sums.add(word, owner, n)
    yield sums.rows()


def _key(*parts: object) -> bytes:
    return hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=16).digest()


#: What a row of a hot segment says of its key: the rest without one code point at a place, the rest, the rest without any one.
_SWAP, _REST, _CUT = 0, 1, 2


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot segments, once for every key that a near word's row of the same segment shares."""
    for b in batches:
        for side, seg, own, word, n in zip(*(b.column(c).to_pylist() for c in ("side", "seg", "own", "word", "n")), strict=True):
            t = word[: len(word) - len(seg)] if side else word[len(seg) :]
            keys = [(_key(side, seg, i, t[:i] + t[i + 1 :]), _SWAP) for i in range(len(t))] + [(_key(side, seg, "", t), _REST)] + [(_key(side, seg, "", d), _CUT) for d in {t[:i] + t[i + 1 :] for i in range(len(t))}]
            m = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.binary()), pa.array([what for _, what in keys], pa.int32()), pa.array([side] * m, pa.int32()), pa.array([own] * m), pa.array([word] * m), pa.array([n] * m, pa.int64())], ["key", "what", "side", "own", "word", "n"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list[tuple]] = {}
    for b in batches:
        for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "what", "side", "own", "word", "n")), strict=True):
            held.setdefault(key, []).append(row)
    sums = _Sums()
    for rows in held.values():
        for what, side, own, owner, n in rows:
            if own:
                for other, _, _, word, _ in rows:
                    if (what == other == _SWAP or what + other == _REST + _CUT and what != other) and near(owner, word) and not _twice(side, word, owner):
                        sums.add(word, owner, n)
    yield sums.rows()


def neighbours(words: DataFrame) -> DataFrame:
    """words: word, n, each word once. word, n, n_near, best (near word of largest n, ties: the smallest), best_n."""
    spark = words.sparkSession
    common.prepare(spark)
    rows = segments(words)
    hot = common.durable(rows.groupBy("side", "seg").agg(F.count("*").alias("rows")).where(F.col("rows") > LIMIT), "segments")
    many, total = hot.count(), 4 * words.count()
    told = F.broadcast(hot) if many <= BROADCAST_SEGMENTS else hot
    cold = rows.join(told, ["side", "seg"], "left_anti") if many else rows
    found = cold.repartition(max(1, -(-total // SHARD)), "side", "seg").mapInArrow(_scan, _FOUND)
    if many:
        busy = rows.join(told.select("side", "seg"), ["side", "seg"], "left_semi")
        size = busy.agg(F.sum(2 * F.length("word") + 1)).first()[0]
        spread = busy.mapInArrow(_spread, "key binary, what int, side int, own boolean, word string, n long")
        found = found.unionByName(spread.repartition(max(1, -(-size // (4 * SHARD))), "key").mapInArrow(_meet, _FOUND))
    both = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = both.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """links: word, form. word, root: the end of the chain of forms, by doubling. Counts rise along a chain, so it ends."""
    now = common.durable(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        new = common.durable(now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        common.discard(now)
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        now = common.durable(new.drop("moved"), "roots")
        common.discard(new)
    raise RuntimeError("forms did not end")


def group(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """docs: doc_id, text. word, form, root, n, n_near, form_n of every word."""
    counted = common.durable(words(docs), "words")
    far = F.col("best_n") >= times * F.col("n")
    found = neighbours(counted).select("word", F.when(far, F.col("best")).alias("form"), "n", "n_near", F.when(far, F.col("best_n")).alias("form_n"))
    found = common.durable(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 (polynomial 0xEDB88320) is folded over bytes with a table made by rule.
ORACLE = """
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
b AS MATERIALIZED (SELECT run, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT run, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, count(*)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rem FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.rem = b.rem AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rem = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rem = w.word),
c AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(a := -other_n, b := other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 10 * w.n THEN best.b END AS form, CASE WHEN -best.a >= 10 * w.n THEN -best.a END AS form_n FROM w LEFT JOIN c USING (word)),
z AS (SELECT word, form, word AS root, form AS ahead FROM f UNION ALL SELECT z.word, z.form, z.ahead, f.form FROM z JOIN f ON z.ahead = f.word)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word AND z.ahead IS NULL
"""
