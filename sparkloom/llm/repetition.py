"""Problem 10: how much of a text repeats what the same text has said before.

A table of measures and thresholds is compiled into one Spark projection; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

#: Words of a phrase.
PHRASE = 5
#: Number or bullet that opens a list line.
LIST_MARK = r"(?m)^[ \t>]*(?:\(?[0-9]{1,4}[.):]|[a-z][.)]|[-*+•])[ \t]+"
#: Scripts written without spaces, whose words are single characters.
_SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
#: A word; and the same where characters of such a script are among the letters.
WORD = r"[\p{L}\p{N}_]++"
MIXED_WORD = rf"[{_SINGLE}]|[\p{{L}}\p{{N}}_&&[^{_SINGLE}]]++"
#: Stands for the end of a sentence or line, right behind its last word.
END = "\x01"
#: The signs and blanks between two words, if a line ends among them or a sentence: at a full stop with a blank.
UNIT_GAP = r"(?=[^\p{L}\p{N}_])(?<=[\p{L}\p{N}_])(?:(?=[^\p{L}\p{N}_]*?[\r\n。！？])|(?=[^\p{L}\p{N}_]*?[.!?])(?=[^\p{L}\p{N}_]*?(?:\s|\z)))[^\p{L}\p{N}_]++"
#: Frequent words of the languages of the corpus.  Fixed values.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "for", "on", "with", "that", "it", "der", "die", "das", "und", "ist", "le", "la", "les", "et", "est", "el", "los", "y", "es", "en", "de", "des", "un", "une", "ein", "eine")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once per row and not again wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def even(text: Column) -> Column:
    """Lower case without list numbers, one blank for several."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), F.lit(LIST_MARK), F.lit("")), F.lit(r"[ \t][ \t]++"), F.lit(" "))


def marked(evened: Column) -> Column:
    """The text with ``END`` in place of what lies between two sentences or lines."""
    return F.regexp_replace(evened, F.lit(UNIT_GAP), F.lit(END))


def words(ended: Column) -> Column:
    """Lower-case words without signs and spaces; a word that ends a sentence or line has ``END`` behind it."""

    def every(word: str) -> Column:
        return F.regexp_extract_all(ended, F.lit(f"(?:{word}){END}?"), F.lit(0))

    return F.when(ended.rlike(f"[{_SINGLE}]"), every(MIXED_WORD)).otherwise(every(WORD))


def places_said_before(w: Column, n: int = PHRASE) -> Column:
    """Ranges (i, size) of words of ``w`` that occurred before: phrases of ``n`` words, and shorter sentences and lines.

    Sentences, lines and paragraphs of ``n`` words or more that recur consist of recurring phrases.
    """
    ends = F.transform(w, lambda x: F.endswith(x, F.lit(END)))
    hashes = F.transform(w, lambda x: F.xxhash64(F.rtrim(x, F.lit(END))))

    def both(z: Column) -> Column:
        h, e = z["h"], z["e"]
        count = F.size(h)
        every = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
        phrases = F.transform(F.slice(every, 1, F.greatest(count - n + 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        starts = F.filter(every, lambda i: F.coalesce(F.get(e, i - 1), (i == 0) & (count > 0)))

        def size(i: Column) -> Column:
            got = F.lit(None).cast("int")
            for k in range(n - 1, 0, -1):
                got = F.when(F.coalesce(F.get(e, i + (k - 1)), F.lit(False)) | (i + k == count), F.lit(k)).otherwise(got)
            return got

        short = F.filter(F.transform(starts, lambda i: F.struct(i.alias("i"), size(i).alias("size"))), lambda u: u["size"].isNotNull())

        def units(u: Column) -> Column:
            hashes = F.transform(u, lambda x: F.xxhash64(x["size"], F.slice(h, x["i"] + 1, x["size"])))
            return repeats(hashes, lambda i: F.get(u, i)["i"], lambda i: F.get(u, i)["size"])

        return F.concat(let(phrases, lambda p: repeats(p, lambda i: i, lambda i: F.lit(n))), let(short, units))

    return let(F.struct(hashes.alias("h"), ends.alias("e")), both)


def repeats(hashes: Column, place: Callable[[Column], Column], size: Callable[[Column], Column]) -> Column:
    """(i, size) of the elements of ``hashes`` that equal an earlier one.  Only lists that have such are sorted."""
    none = F.array().cast("array<struct<i:int,size:int>>")

    def later(s: Column) -> Column:
        at = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], b["i"]))
        return F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.struct(place(i).alias("i"), size(i).alias("size")))

    order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(order, later))


def covered_share(w: Column, ranges: Column) -> Column:
    """Share of the words' characters that lie in ``ranges``, each word counted once however many ranges hold it."""
    places = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["i"], r["i"] + r["size"] - 1))))
    hit = F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: acc + F.length(F.rtrim(F.get(w, i), F.lit(END))))
    total = F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(F.rtrim(x, F.lit(END))))
    return F.when(F.size(ranges) > 0, hit / total).otherwise(F.lit(0.0))


def share_of_repeats(parts: Column) -> Column:
    """Share of characters in array elements equal to another element, the first of each counted as new; 0 if empty."""
    whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    once = F.aggregate(F.array_distinct(parts), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return F.when(whole > 0, 1 - once / whole).otherwise(F.lit(0.0))


#: Signs that do not count at the end of a line or paragraph.
CLOSING = " \t\r\n\f.!?,;:…·-–—*_#/\\|=()[]{}<>«»„“”‘’\"'`~。！？，、；：）】」』"


def pieces(evened: Column, border: str) -> Column:
    """Lines or paragraphs without blanks around them and end punctuation."""
    return F.filter(F.transform(F.split(evened, border), lambda x: F.ltrim(F.rtrim(x, F.lit(CLOSING)))), lambda x: x != "")


def units(ended: Column) -> Column:
    """Sentences and lines without spacing and end punctuation, cut from the whole text at once."""
    return F.filter(F.split(ended, END), lambda x: x != "")


@dataclass(frozen=True)
class Text:
    """What the measures read, each worked out once per row."""

    text: Column
    even: Column
    ended: Column
    words: Column
    said: Column


@dataclass(frozen=True)
class Measure:
    """A row of the threshold table: a name, what it measures, and what decides.

    A text is flagged if some measure reaches its ``at_least``, provided that every measure keeps its bounds ``least``
    and ``most``.
    """

    name: str
    of: Callable[[Text], Column]
    at_least: float | None = None
    least: float | None = None
    most: float | None = None


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


MEASURES = (
    Measure("n_chars", lambda t: F.length(t.text)),
    Measure("n_words", lambda t: F.size(t.words), least=2),
    Measure("symbol_share", lambda t: share(F.length(F.regexp_replace(t.text, r"[\p{L}\p{N}\s]++", "")), F.length(t.text)), most=0.95),
    Measure("stop_word_share", lambda t: share(F.size(F.filter(t.words, lambda x: F.rtrim(x, F.lit(END)).isin(*STOP_WORDS))), F.size(t.words))),
    Measure("repeated_line_share", lambda t: let(pieces(t.even, r"\R"), share_of_repeats), at_least=0.4),
    Measure("repeated_unit_share", lambda t: let(units(t.ended), share_of_repeats), at_least=0.4),
    Measure("repeated_paragraph_share", lambda t: let(pieces(t.even, r"\R[ \t]*+\R\s*+"), share_of_repeats), at_least=0.4),
    Measure("repeated_share", lambda t: covered_share(t.words, F.filter(t.said, lambda r: r["size"] >= PHRASE))),
    Measure("said_before_share", lambda t: covered_share(t.words, t.said), at_least=0.4),
)


def measure(df: DataFrame, text: str = "text", measures: tuple[Measure, ...] = MEASURES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, one column per measure and ``flagged``, as the table of measures decides.

    Projections over the whole text of every row.  A null text counts as empty: all measures 0, not flagged; so does a
    blank one but for its length.  Repeated rows and further columns change nothing.  said_before_share is the share
    of the words' characters in the union of all that was said before: phrases, sentences, lines and paragraphs.
    """
    named = [f"_keep{i}" for i in range(len(keep))]
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.select(*[F.col(c).alias(k) for c, k in zip(keep, named)], t.alias("_text"), even(t).alias("_even"))
    step = step.select("*", marked(F.col("_even")).alias("_ended"))
    step = step.select("*", words(F.col("_ended")).alias("_words"))
    step = step.select("*", places_said_before(F.col("_words")).alias("_said"))
    of = Text(*[F.col(c) for c in ("_text", "_even", "_ended", "_words", "_said")])
    got = step.select(*[F.col(k).alias(c) for k, c in zip(named, keep)], *[m.of(of).alias(m.name) for m in measures])
    hit, kept = F.lit(False), F.lit(True)
    for m in measures:
        if m.at_least is not None:
            hit = hit | (F.col(m.name) >= m.at_least)
        if m.least is not None:
            kept = kept & (F.col(m.name) >= m.least)
        if m.most is not None:
            kept = kept & (F.col(m.name) <= m.most)
    return got.withColumn("flagged", hit & kept)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = measure(spread(table(spark, sf_dir, "documents"), "doc_id"))
    # with a row number the projection stays below the filter; the optimizer would else put its expressions, many times
    # over, in the place of every name in the condition
    return got.withColumn("_row", F.monotonically_increasing_id()).where("flagged AND _row >= 0").select("doc_id").distinct()


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spread(table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", *[F.round(F.col(m.name), 6).alias(m.name) for m in MEASURES], "flagged")


QUERIES = {"p10_found": p10_found, "p10_measures": p10_measures}
SQL: dict[str, str] = {}
