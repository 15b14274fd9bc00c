"""Line dedup by content-defined chunks of lines.

A text is cut into lines, at line ends and, as running text is often one long line,
after sentences; lines that are still very long also after words of certain hashes. A
rolling hash over the hashes of the last two lines decides where a chunk ends, so the
same passage is cut alike wherever it stands. Chunks that occur more than once in the
whole table are compared by their bytes, and runs of them that are long enough stay at
their first place only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerwise.llm.common import free_name, lasting, text_column
from headerwise.sources.scratch import written

#: A chunk ends after a line with this chance (as bits that must be 0).
BOUNDARY_BITS = 1
#: A run of repeated chunks goes if it has so many lines and words, or LONG_LINE words.
MIN_LINES, MIN_WORDS, LONG_LINE = 2, 10, 50
#: Lines of so many bytes are cut, after one in so many words.
CUT_BYTES, CUT_WORDS = 480, 5
#: So many signs of a run without white space count as a word.
WORD_CHARS = 20
#: 64-bit groups of the filter for repeated hashes: 1 << 20 of them take under 64 MB.
SLOTS = 1 << 20

_LINE = r"(?s)(?:(?<=\n)|(?<=[.!?]\x20))(?=.)"
_ENDS = ("\n", ". ", "! ", "? ")
_MARK = "\u0001"
_BLANK = " \t\r\n"
_FAR = r"[\u0E00-\x{10FFFF}]"
#: White space with any of these is counted by a pattern.
_UNEVEN = ("\t", "\r", "\v", "\f", "  ", "\n\n", " \n", "\n ")

_SPACE = r"\s\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, Kana, Han; and their punctuation.
_UNSPACED = (
    r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3001-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
    r"\uFF01\uFF0C\uFF1F\x{20000}-\x{3FFFF}"
)
_WORD = rf"(?:[{_UNSPACED}]|[^{_SPACE}{_UNSPACED}]+|(?=[{_SPACE}]))[{_SPACE}]*"
_COUNTED = rf"[{_UNSPACED}]|[^{_SPACE}{_UNSPACED}]+"
_SPECIAL = rf"[{_UNSPACED}\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _lines(text: Column) -> Column:
    """Pieces that make the text again when put together."""

    def cut(words: Column) -> Column:
        hit = lambda w, i: F.when(
            (F.pmod(F.xxhash64(w), F.lit(CUT_WORDS)) == 0) | (i == F.size(words) - 1), i
        )
        return _bound(F.array_compact(F.transform(words, hit)), lambda ends: _parts(words, ends))

    def one(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(_WORD), F.lit(0))
        return F.when(F.octet_length(line) < CUT_BYTES, F.array(line)).otherwise(_bound(words, cut))

    def cut_long(lines: Column) -> Column:
        long = F.exists(lines, lambda x: F.octet_length(x) >= CUT_BYTES)
        return F.when(long, F.flatten(F.transform(lines, one))).otherwise(lines)

    return _bound(_plain_lines(text), cut_long)


def _plain_lines(text: Column) -> Column:
    """Cut at _LINE, in texts without the mark by putting it there, which is quicker."""
    marked = text
    for end in _ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    marked = F.split(F.rtrim(marked, F.lit(_MARK)), _MARK)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, _LINE)).otherwise(marked)


def _bound(array: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the array, which is computed once however often ``use`` has it."""
    return F.flatten(F.transform(F.array(array), use))


def _parts(words: Column, ends: Column) -> Column:
    """The words put together up to each of the places ``ends``."""

    def part(last: Column, i: Column) -> Column:
        first = F.when(i > 0, F.get(ends, i - 1) + 1).otherwise(0)
        return F.array_join(F.slice(words, first + 1, last - first + 1), "")

    return F.transform(ends, part)


def _words(text: Column) -> Column:
    """Runs of signs between white space; signs of scripts without spaces count singly,
    and so does every WORD_CHARS of a longer run."""
    # one range is looked for much faster than the many that then decide
    far = text.rlike(_FAR) | F.contains(text, F.lit("\u0085")) | F.contains(text, F.lit("\u00a0"))
    ascii_spaces = (F.octet_length(text) == F.length(text)) | ~(far & text.rlike(_SPECIAL))
    # without a pattern where single blanks and line ends are all the white space there is
    uneven = reduce(or_, (F.contains(text, F.lit(c)) for c in _UNEVEN))
    for c in " \n":
        uneven = uneven | F.startswith(text, F.lit(c)) | F.endswith(text, F.lit(c))
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    words = F.when(F.octet_length(text) == 0, 0)
    words = words.when(ascii_spaces & ~uneven, 1 + F.octet_length(text) - F.octet_length(bare))
    words = words.when(ascii_spaces, F.regexp_count(text, F.lit(r"\S+")))
    words = words.otherwise(F.regexp_count(text, F.lit(_COUNTED)))
    return F.greatest(words, F.floor(F.length(text) / WORD_CHARS))


def _ends_in(text: Column, signs: str) -> Column:
    return reduce(or_, (F.endswith(text, F.lit(c)) for c in signs))


def _rtrim(text: Column) -> Column:
    """``rtrim`` of _BLANK, which goes through the whole text, only where blanks alone
    are not enough."""
    plain = F.rtrim(text)
    return F.when(_ends_in(plain, "\t\r\n"), F.rtrim(text, F.lit(_BLANK))).otherwise(plain)


def _trim(text: Column) -> Column:
    plain = F.trim(text)
    starts = reduce(or_, (F.startswith(plain, F.lit(c)) for c in "\t\r\n"))
    more = starts | _ends_in(plain, "\t\r\n")
    return F.when(more, F.btrim(text, F.lit(_BLANK))).otherwise(plain)


def _ends(hashes: str) -> Column:
    """Places of the lines that end a chunk: by the rolling hash, and the last one."""

    def ends(i: Column) -> Column:
        before, here = F.get(hashes, i - 1), F.get(hashes, i)
        turned = F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63))
        rolled = F.when(i > 0, turned.bitwiseXOR(here)).otherwise(here)
        low = rolled.bitwiseAND(F.lit((1 << BOUNDARY_BITS) - 1).cast("long")) == 0
        return low | (i == F.size(hashes) - 1)

    return F.filter(F.expr(f"sequence(0, size({hashes}) - 1)"), ends)


def _chunked(docs: DataFrame, chunks: str, sizes: str, hashes: str) -> DataFrame:
    """Adds the chunks of ``text``, which make it again when put together, the number of
    lines of each, and its hash without white space at its ends; null if that is all."""
    rows = docs.withColumn(chunks, _lines(F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.withColumn(sizes, F.transform(chunks, lambda x: F.xxhash64(_rtrim(x))))
    rows = rows.withColumn(sizes, _ends(sizes))

    def size(end: Column, k: Column) -> Column:
        return end - F.when(k > 0, F.get(sizes, k - 1)).otherwise(F.lit(-1))

    def chunk(end: Column, k: Column) -> Column:
        lines = F.when(size(end, k) == 1, F.get(chunks, end))
        return lines.otherwise(
            F.array_join(F.slice(chunks, end + 2 - size(end, k), size(end, k)), "")
        )

    def stamp(x: Column) -> Column:
        return F.transform(F.array(_trim(x)), lambda t: F.when(t != "", F.xxhash64(t)))[0]

    # as generated columns they are computed once, whatever is then made of them
    both = F.struct(F.transform(sizes, chunk).alias(chunks), F.transform(sizes, size).alias(sizes))
    rows = rows.select(*docs.columns, F.inline(F.array(both)))
    return rows.withColumn(hashes, F.transform(chunks, stamp))


def _maybe_repeated(chunks: DataFrame) -> DataFrame:
    """The chunks whose hash occurs again, and few others, picked before any shuffle.

    Only hashes are counted. Those that occur again set bits of a filter of bounded
    size, which is broadcast; chunks that slip through find no partner later.
    """
    slot = F.pmod(F.shiftright("h1", 6), F.lit(SLOTS)).alias("slot")
    bit = F.expr("shiftleft(1L, CAST(h1 & 63 AS INT))")
    again = chunks.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = written(again.groupBy(slot).agg(F.bit_or(bit).alias("bits")), "repeated")
    found = chunks.withColumn("slot", slot).join(F.broadcast(bits), "slot")
    return found.where(F.col("bits").bitwiseAND(bit) != 0).drop("slot", "bits")


def _repeats(rows: DataFrame) -> DataFrame:
    """The runs that go: ``doc_id, print, gone``, of the ``first`` and ``last`` chunk;
    ``rows`` have ``doc_id, print, chunks, sizes, hashes``."""
    each = F.arrays_zip(
        F.expr("sequence(0, size(chunks) - 1)").alias("k"),
        F.col("sizes").alias("size"),
        F.col("chunks").alias("chunk"),
        F.col("hashes").alias("h1"),
    )
    found = _maybe_repeated(rows.select("doc_id", "print", F.inline(each)).where("h1 IS NOT NULL"))
    found = found.withColumn("chunk", _trim(F.col("chunk")))
    found = found.withColumn("h2", F.xxhash64("chunk", F.lit(1)))
    place = F.struct("doc_id", "print", "k")
    chunks = found.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(place).alias("first"),
        F.min("chunk").alias("low"),
        F.max("chunk").alias("high"),
    )
    # the byte comparison: different chunks that share both hashes all stay
    chunks = chunks.where("n > 1 AND low = high").select("h1", "h2", "first")
    # read once more rather than written with all its text
    again = found.withColumn("words", _words(F.col("chunk"))).drop("chunk").join(chunks.hint("merge"), ["h1", "h2"])
    again = again.where(~place.eqNullSafe(F.col("first")))
    # rows that agree in doc_id and text have each chunk several times
    again = again.dropDuplicates(["doc_id", "print", "k"])
    # neighbours have the same difference of place and rank
    rank = F.row_number().over(Window.partitionBy("doc_id", "print").orderBy("k"))
    runs = again.withColumn("run", F.col("k") - rank).groupBy("doc_id", "print", "run").agg(
        F.min("k").alias("first"),
        F.max("k").alias("last"),
        F.sum("size").alias("lines"),
        F.sum("words").alias("words"),
    )
    runs = runs.where(
        (F.col("lines") >= MIN_LINES) & (F.col("words") >= MIN_WORDS) | (F.col("words") >= LONG_LINE)
    )
    return runs.groupBy("doc_id", "print").agg(
        F.collect_set(F.struct("first", "last")).alias("gone")
    )


def deduplicated_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) without passages that came before.

    A chunk that occurs several times came before wherever it is not the first, that of
    the smallest doc_id (null first), text fingerprint and place. A run of neighbouring
    chunks that came before goes if it has at least two lines and ten words, or fifty
    words; only its own words count. So the chunks at both ends of a repeated passage,
    which may reach beyond it, stay. White space at the ends of a chunk does not count.
    Words are runs between white space of any kind; in scripts without spaces every sign
    is one, and 20 signs of any long run are.

    Null and empty texts stay as they are. Rows that agree in doc_id and text are treated
    alike: a chunk stays in all of them or in none. All rows and columns stay; with
    ``report`` the columns ``n_lines``, ``n_chunks`` and ``n_removed`` (chunks) are added,
    replacing any of those names. An empty table gives an empty result.
    """
    docs = text_column(docs, "text")
    own, stamp, mark, gone, chunks, sizes, hashes = (
        free_name(docs.columns, f"_{n}")
        for n in ("id", "print", "mark", "gone", "chunks", "sizes", "hashes")
    )
    # texts are cut once; what follows reads the pieces
    cut = _chunked(docs, chunks, sizes, hashes).withColumn(mark, F.xxhash64("text"))
    # only whether there is a text is kept of it
    cut = written(cut.withColumn("text", F.when(F.col("text").isNotNull(), "")), "cut")
    pieces = cut.selectExpr(
        "doc_id", f"{mark} AS print", f"{chunks} AS chunks", f"{sizes} AS sizes", f"{hashes} AS hashes"
    )
    repeats = lasting(docs.sparkSession, "repeats", lambda: _repeats(pieces)).select(
        F.col("doc_id").alias(own),
        F.col("print").alias(stamp),
        F.flatten(F.transform("gone", lambda r: F.sequence(r["first"], r["last"]))).alias(gone),
    )
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(stamp))
    lines = F.aggregate(sizes, F.lit(0), lambda n, x: n + x)
    rows = cut.drop(hashes).withColumn(sizes, lines).join(repeats.hint("merge"), same, "left")
    stay = F.array_except(F.expr(f"sequence(0, size({chunks}) - 1)"), F.col(gone))
    rest = F.array_join(F.transform(stay, lambda k: F.get(chunks, k)), "")
    added = {}
    if report:
        some = F.col(chunks) != F.array(F.lit(""))
        added = {
            "n_lines": F.when(some, F.col(sizes)).otherwise(0).cast("long"),
            "n_chunks": F.when(some, F.size(chunks)).otherwise(0).cast("long"),
            "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        }
        rows = rows.drop(*[c for c in added if c in docs.columns])
    text = F.when(F.col(gone).isNotNull(), rest)
    text = text.when(F.col("text").isNotNull(), F.array_join(chunks, ""))
    order = [c for c in docs.columns if c not in added]
    # as a generated column the text is computed once, whatever is then asked of it
    rows = rows.withColumns(added).withColumn(own, F.explode(F.array(text)))
    return rows.select(*[F.col(own).alias("text") if c == "text" else c for c in order], *added)


def line_report(docs: DataFrame) -> DataFrame:
    """``deduplicated_lines`` of ``doc_id`` and ``text`` with its counts, which see."""
    return deduplicated_lines(docs.select("doc_id", "text"), report=True)
