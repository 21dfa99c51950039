"""Spelling variants: words that differ by one code point, found without forming pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small, stored, trimmed

#: Letters after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Every so many runs lose a code point.
LOSE = 199
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000


def lossy(run: str, start: int) -> str:
    """run, without one code point if LOSE divides its crc32, which goes on from start (the crc32 of what stands before)."""
    h = zlib.crc32(run.encode(), start)
    if h % LOSE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(min_chars: int):
    """For mapInArrow on (id as text, text): words and their numbers, summed over what a task holds at a time."""
    # A shorter run can't become a word.
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), pc.ascii_lower(batch.column("text")), strict=True):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for found, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = lossy(found, start)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return run


KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("rank", pa.int64())])


def _spread(batch: pa.RecordBatch, parts) -> pa.RecordBatch:
    """A row (128-bit hash, rank) for each of parts(word)."""
    hashed, ranks = [], []
    for rank, word in zip(batch.column("rank").to_pylist(), batch.column("word").to_pylist(), strict=True):
        mine = [xxhash.xxh3_128_digest(p) for p in parts(word)]
        hashed += mine
        ranks += [rank] * len(mine)
    both = pa.Array.from_buffers(pa.int64(), 2 * len(ranks), [None, pa.py_buffer(b"".join(hashed))])
    at = pa.array(range(0, 2 * len(ranks), 2), pa.int64())
    return pa.RecordBatch.from_arrays([both.take(at), both.take(pc.add(at, 1)), pa.array(ranks, pa.int64())], schema=KEYS)


def wildcards(word: str):
    """(prefix, suffix) around each position; the prefix tells the position. No UTF-8 holds the byte between them."""
    for i in range(len(word)):
        yield word[:i].encode() + b"\xff" + word[i + 1 :].encode()


def deletions(word: str):
    """The distinct results of deleting one code point: of a run of the same one, only the first is deleted."""
    for i, c in enumerate(word):
        if not i or word[i - 1] != c:
            yield (word[:i] + word[i + 1 :]).encode()


def whole(word: str):
    yield word.encode()


def _keys(words: DataFrame, parts) -> DataFrame:
    run = lambda batches: (_spread(b, parts) for b in batches)
    return words.select("rank", "word").mapInArrow(trimmed(run, words.sparkSession), "h1 long, h2 long, rank long")


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_n: int) -> DataFrame:
    """(rank, word, n), stored: ranks rise as n falls, and where n is the same with the words in code-point order."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(trimmed(count_words(min_chars), docs.sparkSession), "word string, n long")
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)
    return stored(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "spelling-words")


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best) of the words that have near ones: their number and the least rank among them.

    Replacements: words that share a position, a prefix and a suffix are a group. It can't hold more words than there are
    letters (90), keeps its size and its two first words, and tells each member how many others it has and which is the
    first of them. Two words share one group at most. Insertions and deletions: each word's distinct deletions are
    looked up in the vocabulary; the pairs found are no more than the words' letters. Both are summed by word."""
    groups = _keys(words, wildcards).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("rank")).alias("members")).where(F.size("members") > 1)
    first, second = F.get("members", F.lit(0)), F.get("members", F.lit(1))
    groups = groups.select((F.size("members") - 1).cast("long").alias("n_near"), first.alias("first"), second.alias("second"), F.explode("members").alias("rank"))
    replaced = groups.select("rank", "n_near", F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    shorter = _keys(words, whole).withColumnRenamed("rank", "short")
    indels = _keys(words, deletions).join(shorter, ["h1", "h2"])
    indels = indels.select(F.explode(F.array(F.struct("rank", F.col("short").alias("best")), F.struct(F.col("short").alias("rank"), F.col("rank").alias("best")))).alias("p"))
    indels = indels.select("p.rank", F.lit(1).cast("long").alias("n_near"), "p.best")
    return replaced.unionByName(indels).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """(rank, root) of links (rank, to), stored: where a chain of at most `longest` links ends. Each round doubles the stride."""
    out, stride = links.select("rank", F.col("to").alias("root")), 1
    while stride < longest:
        ahead = out.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        out = stored(out.join(small(ahead), "root", "left").select("rank", F.coalesce("further", "root").alias("root")), "spelling-roots")
        stride *= 2
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_n: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of docs.

    Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased. A run whose crc32, of
    `<id>:<run>` in UTF-8, is divisible by 199 loses the code point at crc32 modulo its length. Words are the distinct
    results of at least min_chars code points that occur at least min_n times. Near words differ by one code point that
    is inserted, deleted or replaced. A word's form is its near word of largest n, the first in code-point order among
    several, if that n is at least ratio times the word's; root is where the forms lead in the end.

    Null texts have no runs, a null id counts as an empty text; rows that repeat count each time; empty tables give no
    rows; other columns aren't looked at. A text may be one long run: memory grows with a word's length, time with its
    square. Words are counted within a task before they are shuffled, so a frequent word costs a row for each task.
    Deleted words and groups are told apart by 128-bit hashes."""
    words = vocabulary(docs, id_col, text_col, min_chars, min_n)
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    judged = words.join(near_words(words), "rank", "left").join(small(best), "best", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    judged = judged.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(has, F.col(c)).alias(c) for c in ("best", "form", "form_n")))
    judged = stored(judged, "spelling-judged")
    top, longest = words.agg(F.max("n")).first()[0] or 0, 0
    while min_n * ratio ** (longest + 1) <= top:
        longest += 1
    ends = roots(judged.where("best IS NOT NULL").select("rank", F.col("best").alias("to")), longest)
    named = words.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    ends = stored(ends.join(small(named), "root").select("rank", F.col("root_word").alias("root")), "spelling-ends")
    out = judged.join(small(ends), "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 by bytes: 256 remainders, then a byte at a time.
CRC_SQL = r"""crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for crc32 of a text's UTF-8 bytes, with tab from crc_table."""
    return f"xor(list_reduce(list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


SQL = rf"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, {crc_sql("s")} AS h FROM d, crc_table),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
x AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) AS a, substr(word, CAST(i AS INT) + 2) AS b FROM p),
e AS (SELECT DISTINCT word, a || b AS shorter FROM x),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM x JOIN x AS y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT e.word, w.word, w.n FROM e JOIN w ON w.word = e.shorter
  UNION ALL SELECT w.word, e.word, v.n FROM e JOIN w ON w.word = e.shorter JOIN w AS v ON v.word = e.word),
g AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
f AS (SELECT near.word, min(other) AS best, any_value(top) AS top FROM near JOIN g ON g.word = near.word AND near.other_n = g.top GROUP BY near.word),
j AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN f.top >= 5 * w.n THEN best END AS form, CASE WHEN f.top >= 5 * w.n THEN f.top END AS form_n
  FROM w LEFT JOIN g ON g.word = w.word LEFT JOIN f ON f.word = w.word),
t AS (SELECT word, word AS root FROM j WHERE form IS NULL UNION ALL SELECT j.word, t.root FROM j JOIN t ON j.form = t.word)
SELECT j.word, form, root, n, n_near, form_n FROM j JOIN t ON t.word = j.word
"""
