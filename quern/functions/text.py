"""Text functions as column expressions. They run in the JVM, but for Unicode normalisation, case folding and HTML entities, which Spark has no
function for: those are UDFs over Arrow batches."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The longest chunk and the end of a sentence.
CHUNK_CHARS = 1000
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
#: What ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
#: Hyphens and dashes that count as "-".
DASHES = "‐‑–"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "­": ""}


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; only the ends are read."""
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def lemmas(text: Column, shortest: int = 3) -> Column:
    """The distinct tokens of at least ``shortest`` letters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= shortest))


def chunk_text(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Chunks of whole sentences up to ``most`` code points; longer sentences are cut hard. Empty texts have none."""
    # The split takes the white space between sentences whole, so only the ends of the text can have some.
    sentences = F.filter(F.split(strip(F.coalesce(text, F.lit(""))), SENTENCE_END), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(s) + 1 > most) & (acc["cur"] != "")
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        cuts = F.floor((F.length(s) - 1) / most).cast("int")
        slices = F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: F.substring(s, i * most + 1, F.lit(most)))
        done = F.when(cuts > 0, F.concat(done, slices)).otherwise(done)
        rest = strip(F.substring(s, cuts * most + 1, F.lit(most)))
        # Sentences have no white space at their ends: only a hard cut can leave some, and it starts a chunk. A growing chunk is not searched for it again.
        cur = F.when(cuts > 0, rest).when(full | (acc["cur"] == ""), s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.aggregate(sentences, start, add, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def short_lang(value: Column) -> Column:
    """``cs_CZ`` and ``en-US`` as ``cs`` and ``en``; blank as null."""
    return F.nullif(F.lower(F.trim(F.split(F.replace(value, F.lit("-"), F.lit("_")), "_")[0])), F.lit(""))


#: Texts that are Python strings at a time; texts of a length that may be remembered, and how many.
PIECE, SHORT, MOST_KNOWN = 256, 200, 10_000


def pieces(*columns: pa.Array) -> Iterator[list]:
    """The rows of an Arrow batch as Python values, a piece at a time: a batch may hold 10,000 long texts, and as strings they take several times their bytes."""
    for at in range(0, len(columns[0]), PIECE):
        yield list(zip(*[c.slice(at, PIECE).to_pylist() for c in columns], strict=True))


def _each(function: Callable[[str], str]):
    """An Arrow UDF of a function of a text; null stays null, and short texts that come again are done once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}

        def one(text: str | None) -> str | None:
            if text is None or len(text) > SHORT:
                return None if text is None else function(text)
            if text not in known:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                known[text] = function(text)
            return known[text]

        for batch in batches:
            for piece in pieces(batch):
                yield pa.array([one(t) for (t,) in piece], pa.string())

    return F.arrow_udf(run, StringType())


def _key(text: str) -> str:
    plain = text.casefold()
    if not plain.isascii():
        plain = "".join([c for c in unicodedata.normalize("NFKD", plain) if c < _FIRST_MARK or not unicodedata.combining(c)])
    return _SIGNS.sub(" ", plain).strip()


def _typed(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).translate(_DASHED).casefold().split())


def _unescaped(text: str) -> str:
    while "&" in text and (plain := html.unescape(text)) != text:
        text = plain
    return text


def _closed(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" or found[0][1:] in html.entities.html5 else found[0]


def _unescaped_closed(text: str) -> str:
    while "&" in text and (plain := _CLOSED.sub(_closed, text)) != text:
        text = plain
    return text


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_SIGNS, _FIRST_MARK = re.compile(r"[\W_]+"), "\u0300"
_DASHED = str.maketrans(dict.fromkeys(DASHES, "-"))
_LIGATED = str.maketrans(LIGATURES)


#: Case-folded letters and digits without marks, other signs as single spaces: what two spellings of a title share.
equality_key = _each(_key)
#: A term as a user types it: composed, dashes as "-", case-folded, single spaces.
typed = _each(_typed)
#: Composed characters, ligatures written out, soft hyphens gone.
prepare = _each(lambda t: unicodedata.normalize("NFC", t).translate(_LIGATED))
#: HTML entities, named and numeric, undone until none is left, however deep one stands in another.
unescape = _each(_unescaped)
#: The same of entities that end with a semicolon only: in a cut page, or before other letters, ``&amp`` stays.
unescape_closed = _each(_unescaped_closed)


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, r"<[^>]*>", " "))


def query_text(text: Column, escaped: bool = False) -> Column:
    """A query for a search server: no percent signs, single spaces, and, if asked for, its special signs escaped."""
    plain = squeeze(F.replace(text, F.lit("%"), F.lit("")))
    return F.regexp_replace(plain, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1") if escaped else plain


def copy_share(query: Column, title: Column) -> Column:
    """Share of the query's lemmas that the title has; 1 for a query without lemmas."""
    own = lemmas(query)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, lemmas(title))) / F.size(own))


def cut_keywords(text: Column, heading: str = r"\s(?:Keywords|Key words|Klíčová slova)\s*:") -> Column:
    """(text, cut): the text before a trailing keyword list, unless that stands in the first sentence."""
    at = F.regexp_instr(text, F.lit(heading))
    first = F.regexp_instr(text, F.lit(r"[.!?]\s"))
    cut = (at > 0) & (first > 0) & (at > first)
    return F.struct(F.when(cut, F.rtrim(F.substring(text, F.lit(1), at - 1))).otherwise(text).alias("text"), cut.alias("cut"))


def snippet(text: Column, most: int = 160) -> Column:
    return F.substring(squeeze(text), 1, most)


def fill(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def first_json(text: Column, schema: str) -> Column:
    """The first JSON object in free text, parsed; null if there is none or it lacks the form."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
