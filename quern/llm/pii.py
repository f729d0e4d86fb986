"""Personal data and secrets: overlapping candidates, boosted trees over format and context, calibrated thresholds.

All of it is DataFrame expressions; no row leaves the JVM. Spans come from ``regexp_extract_all``: every pattern is
``\\G(gap)(match)`` with a possessive gap, so a text is read once from left to right, and the lengths of gaps and matches
give the positions (code points). Patterns have no nested backtracking; their time is linear and
their stack constant whatever the text.

Base spans (email, ip, card, phone) pass the rule of their kind and are always selected. Generators of high recall propose
further spans, several for each kind, so that proposals overlap: written-out addresses, whole and shortened IPv6, card numbers with other separators,
national and local phone numbers, values assigned to names such as ``password``, and long mixed strings (kind ``secret``). Every proposal is described by
``BITS`` yes/no features of its format and of the text around it, and boosted trees score it. Selected spans of a kind may overlap; equal ones are one.

Fit: the trees learn from texts with known spans, not from the rules. ``planted`` writes ``SYNTHETIC`` short texts with a seeded generator: pieces of at most
``CARRIERS`` documents chosen by hash, with an item in between that is personal data in one of many forms or a hard negative (dates, versions, ISBNs, commit
hashes, UUIDs, numbers that fail the Luhn check). A proposal is right if it covers a planted item of its kind. Half of the texts fits the
trees; on the other half each kind's threshold is the least at which precision reaches ``PRECISION``, and ``Trees.recall`` keeps the recall there. Nothing in this
depends on how large the corpus is.

Plan: one bounded look at carriers, one bounded job over the planted texts, then one pass over all documents without a shuffle.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import hidden, shuffle_partitions

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Planted texts, and documents of which pieces of at most ``CARRIER_CHARS`` characters stand around the planted items.
SYNTHETIC, CARRIERS, CARRIER_CHARS = 9_000, 2_000, 240
PRECISION = 0.98
TREES, DEPTH, RATE = 40, 4, 0.3
#: Characters before a candidate that are looked at.
CONTEXT = 24

_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[ -][0-9]++)*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = {
    "email": rf"\G((?:[^A-Za-z0-9._%+-]++|{_LOCAL}++(?!@{_DOMAIN}))*+)({_LOCAL}++@{_DOMAIN})",
    "ip": rf"\G((?:[^0-9]++|[0-9]++(?!\.[0-9]++\.[0-9]++\.[0-9]))*+)({_IP})",
    # Runs of fewer than 13 digits are part of the gap.
    "card": rf"\G((?:[^0-9]++|(?!(?:[0-9][ -]?){{12}}[0-9]){_CARD})*+)({_CARD})",
    "phone": rf"\G((?:[^+]++|\+(?![0-9][ ().0-9-]+[0-9]))*+)({_PHONE})",
}
_NAME = r"[A-Za-z0-9-]++"
_BRACKETED = rf"{_LOCAL}++ ?[\[({{<] ?(?:at|AT|@) ?[\])}}>] ?{_NAME}(?:(?: ?[\[({{<] ?(?:dot|DOT|\.) ?[\])}}>] ?|\.){_NAME})++"
_SPOKEN = rf"{_LOCAL}++ (?:at|AT) {_NAME}(?: (?:dot|DOT) {_NAME})++"
_HEX = r"[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?<![0-9A-Za-z:]){_HEX}(?::{_HEX}){{7}}(?![0-9A-Za-z:])"
_SHORT6 = rf"(?<![0-9A-Za-z:])(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?(?![0-9A-Za-z:])"
_ANY_CARD = r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])"
_FOURS = r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])"
_NATIONAL = r"(?<![0-9+(])(?:\(0?[0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){0,3}(?![0-9])"
_LOCAL_NUMBER = r"(?<![0-9+])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_LABEL = r"(?:[Pp]ass(?:word|wd|phrase|code)?|PASSWORD|PASSWD|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS_?KEY|[Pp]rivate[_-]?[Kk]ey|[Bb]earer|[Cc]redentials?)"
_GIVEN = _LABEL + r"""["']?\s{0,3}(?:[:=]|=>|is)?\s{0,3}["']?"""
_VALUE = r"""[^\s"'<>,;]{6,200}"""
_OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,60}[0-9])[A-Za-z0-9+/_-]{16,200}={0,2}(?![A-Za-z0-9+/_=-])"


def _scan(others: str, run: str, match: str) -> str:
    """A pattern of gap, match and the character behind: ``others`` cannot begin a match, ``run`` is passed over where none begins."""
    return rf"\G((?:{others}|(?!{match}){run})*+)({match})(?=([\s\S]?))"


#: (kind, what a text without which cannot hold a match, pattern).
GENERATORS = (
    ("email", r"[\[({<] ?(?:at|AT|@) ?[\])}>]", _scan(r"[^A-Za-z0-9._%+-]++", rf"{_LOCAL}++", _BRACKETED)),
    ("email", r" (?:dot|DOT) ", _scan(r"[^A-Za-z0-9._%+-]++", rf"{_LOCAL}++", _SPOKEN)),
    ("ip", ":", _scan(r"[^0-9A-Fa-f]++", r"[0-9A-Fa-f]++", _IPV6)),
    ("ip", "::", _scan(r"[^0-9A-Fa-f:]++", r"[0-9A-Fa-f:]", _SHORT6)),
    ("card", "[0-9][ ./_-]{0,2}[0-9]", _scan(r"[^0-9]++", r"[0-9]++", _ANY_CARD)),
    ("card", "[0-9]{4}", _scan(r"[^0-9]++", r"[0-9]++", _FOURS)),
    ("phone", "[0-9]{2}", _scan(r"[^0-9(]++", r"[0-9(]", _NATIONAL)),
    ("phone", "[0-9]{3}[ .-][0-9]{4}", _scan(r"[^0-9]++", r"[0-9]++", _LOCAL_NUMBER)),
    # The name and the sign before the value belong to the gap.
    ("secret", _LABEL, rf"\G((?:[^AaBbCcPpSsTt]++|(?!{_GIVEN}{_VALUE})[AaBbCcPpSsTt])*+{_GIVEN})({_VALUE})(?=([\s\S]?))"),
    ("secret", "[0-9]", _scan(r"[^A-Za-z0-9+/_=-]++", r"[A-Za-z0-9+/_=-]++", _OPAQUE)),
)
#: A text without these cannot hold the base kind.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+"}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CUES = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|pay|account|host|server|addr|ip|reach|from|to)[a-z]*[ :=(#-]*$"
_AGAINST = r"(?i)(?:commit|sha-?[0-9]*|md5|hash|digest|uuid|isbn|issn|doi|version|release|page|pages|pp|date|dated|chapter|section|order|part|ref|revision|rev|build|figure|score|at|until|between|namespace|class|path|slug|id)[ .:=(#-]*$"
_NAMED = rf"{_GIVEN}$"
_SPAN = "array<struct<start:int,end:int,text:string,left:string,right:string>>"
BLOCK = 256


def _sums(pieces: Column) -> Column:
    """The lengths of blocks of gaps and matches."""
    last = F.ceil(F.size(pieces) / F.lit(BLOCK)).cast("int") - 1
    block = lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))
    every = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
    return F.when(F.size(pieces) > 0, every).otherwise(F.array().cast("array<int>"))


def _placed(pieces: Column, sums: Column) -> Column:
    """Gap and match lengths to positions: a running sum, block by block. Both are columns that are made before, so that nothing is computed for each block again."""
    block = lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))

    def run(b: Column) -> Column:
        before = F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, x: a + x)
        first = F.struct(before.alias("at"), F.array().cast(_SPAN).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(
                start.alias("start"), (start + x["size"]).alias("end"), x["text"].alias("text"), x["left"].alias("left"), x["right"].alias("right")
            )
            return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block(b), first, add, lambda acc: acc["out"])

    placed = F.flatten(F.transform(F.sequence(F.lit(0), F.size(sums) - 1), run))
    return F.when(F.size(sums) > 0, placed).otherwise(F.array().cast(_SPAN))


def _pieces(text: Column, pattern: str, needs: str, ahead: bool) -> Column:
    """Gaps and matches of a pattern in a text, in order."""
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("g"), part(2).alias("m"), (part(3) if ahead else part(2)).alias("r"))
    right = (lambda x: x["r"]) if ahead else (lambda x: F.lit(""))
    shaped = F.transform(
        zipped,
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["m"].alias("text"),
            F.right(x["g"], F.lit(CONTEXT)).alias("left"), right(x).alias("right"),
        ),
    )
    empty = F.array().cast("array<struct<gap:int,size:int,text:string,left:string,right:string>>")
    return F.when(text.rlike(needs), shaped).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.try_cast("int") + 1)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes(kind: str, text: Column) -> Column:
    """The rule of a kind for a match of its base pattern."""
    if kind == "ip":
        return text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(text)).between(13, 19) & luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


BITS = (
    "card_length", "phone_length", "luhn", "top_level_name", "spaces", "dots", "dashes", "bracket_first", "free_left", "free_right", "cue", "against", "named",
    "upper", "lower", "digit", "hex", "varied", "long", "longer", "year", "date", "uuid", "double_colon", "groups", "words", "assigned",
    *(f"kind_{k}" for k in KINDS),
)


def _quoted(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bits(kind: str) -> str:
    """SQL of the array of yes/no features (0 or 1) of a candidate ``x``, in the order of ``BITS``. As SQL it is one expression to parse, where columns would be hundreds of calls."""
    text, left, number = "x.text", "x.left", "regexp_replace(x.text, '[^0-9]', '')"
    like = lambda what, pattern: f"{what} RLIKE {_quoted(pattern)}"
    doubled = "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), CAST(d AS INT) + 1)"
    checked = f"aggregate(transform(reverse(filter(split({number}, ''), d -> d <> '')), (d, i) -> IF(i % 2 = 0, CAST(d AS INT), {doubled})), 0, (a, d) -> a + d) % 10 = 0"
    asked = [
        f"length({number}) BETWEEN 13 AND 19", f"length({number}) BETWEEN 9 AND 12", f"{number} <> '' AND {checked}",
        like(text, r"(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )[A-Za-z]{2,6}$"),
        f"contains({text}, ' ')", f"contains({text}, '.')", f"contains({text}, '-')", f"startswith({text}, '(')",
        f"NOT {like(left, r'[A-Za-z0-9/._-]$')}", f"NOT {like('x.right', r'[A-Za-z0-9/_-]')}",
        like(left, _CUES), like(left, _AGAINST), like(left, _NAMED), like(text, "[A-Z]"), like(text, "[a-z]"), like(text, "[0-9]"), like(text, "^[0-9A-Fa-f]+$"),
        f"size(array_distinct(split(left({text}, 64), ''))) >= 10", f"length({text}) >= 20", f"length({text}) >= 32", like(text, r"^(?:19|20)[0-9]{2}\b"),
        like(text, r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})\b"),
        like(text, "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"),
        f"contains({text}, '::')", f"size(split({text}, '[ .:/_-]+')) >= 4", like(text, r"[a-z]{3,}[-_/][a-z]{3,}"), like(left, r"""[:=]\s*["']?$"""),
        *[str(kind == k).lower() for k in KINDS],
    ]
    return f"array({', '.join(f'IF({x}, 1, 0)' for x in asked)})"


def _candidates(docs: DataFrame, text: str, base: bool) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` with arrays of placed candidates: of each base kind (if asked for), then of each generator; and the names of these columns."""
    own, more = [hidden(docs, f"base_{k}") for k in BASE_KINDS] if base else [], [hidden(docs, f"found_{i}") for i in range(len(GENERATORS))]
    whole = F.coalesce(F.col(text), F.lit(""))
    scans = [(n, BASE[k], NEEDS[k], False) for n, k in zip(own, BASE_KINDS, strict=False)] + [(n, g[2], g[1], True) for n, g in zip(more, GENERATORS, strict=True)]
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*names, *[_pieces(whole, pattern, needs, ahead).alias(n) for n, pattern, needs, ahead in scans])
    rows = rows.select(*names, *own, *more, *[_sums(F.col(n)).alias(f"{n}_sums") for n in (*own, *more)])
    return rows.select(*names, *[_placed(F.col(n), F.col(f"{n}_sums")).alias(n) for n in (*own, *more)]), own, more


@dataclass
class Trees:
    """Boosted trees over ``BITS`` (nested tuples: bit, if off, if on; or a leaf), and by kind a threshold and the recall and precision at it on the calibration half."""

    start: float
    trees: list
    thresholds: dict[str, float]
    recall: dict[str, float] = field(default_factory=dict)
    precision: dict[str, float] = field(default_factory=dict)

    def flat(self) -> list[tuple[list[int], list[float]]]:
        """Each tree as complete: the bits asked in breadth-first order and the values of the leaves; above a leaf that comes early any bit will do."""
        out = []
        for tree in self.trees:
            level, asked = [tree], []
            for _ in range(DEPTH):
                asked += [t[0] if isinstance(t, tuple) else 0 for t in level]
                level = [x for t in level for x in (t[1:] if isinstance(t, tuple) else (t, t))]
            out.append((asked, [float(x) for x in level]))
        return out

    def margin(self, bits: Column) -> Column:
        """The trees are data in the expression, walked level by level, so the plan stays small."""
        flat = self.flat()
        if not flat:
            return F.lit(float(self.start))
        trees = F.from_json(F.lit(json.dumps([{"asked": a, "values": v} for a, v in flat])), "array<struct<asked:array<int>,values:array<double>>>")
        inner = 2**DEPTH - 1

        def walk(total: Column, tree: Column) -> Column:
            node = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), lambda at, _: 2 * at + 1 + F.get(bits, F.get(tree["asked"], at)))
            return total + F.get(tree["values"], node - inner)

        return F.aggregate(trees, F.lit(float(self.start)), walk)

    def probability(self, bits: Column) -> Column:
        return 1 / (1 + F.exp(-self.margin(bits)))

    def of(self, cells: np.ndarray) -> np.ndarray:
        def walk(tree, rows: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            on = rows[:, tree[0]] == 1
            return np.where(on, walk(tree[2], rows), walk(tree[1], rows))

        return 1 / (1 + np.exp(-(self.start + sum(walk(t, cells) for t in self.trees))))


def boost(cells: np.ndarray, yes: np.ndarray, no: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over counted feature combinations. Without counts: one even leaf."""
    total = yes + no
    if not total.sum():
        return Trees(0.0, [], {})
    share = (yes.sum() + 1) / (total.sum() + 2)
    model = Trees(float(np.log(share / (1 - share))), [], {})
    margin = np.full(len(cells), model.start)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(-RATE * g / (h + 1))
        best, gain = None, 1e-6
        for bit in range(cells.shape[1] if depth else 0):
            on = rows[cells[rows, bit] == 1]
            if 0 < len(on) < len(rows):
                gl, hl = grad[on].sum(), hess[on].sum()
                better = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if better > gain:
                    best, gain = bit, better
        if best is None:
            return leaf
        on = cells[rows, best] == 1
        return best, grow(rows[~on], grad, hess, depth - 1), grow(rows[on], grad, hess, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(cells)), total * p - yes, total * p * (1 - p), DEPTH)
        model.trees.append(tree)
        margin = np.log(np.clip(model.of(cells), 1e-12, 1 - 1e-12) / np.clip(1 - model.of(cells), 1e-12, 1))
    return model


def _luhn_tail(digits: str) -> str:
    """``digits`` with the last one that makes them pass the Luhn check."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def _item(rng: random.Random) -> tuple[str, str, str, bool]:
    """(kind, what stands before, the item, whether it is personal data or a secret)."""
    kind, good = rng.choice(KINDS), rng.random() < 0.55
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    wide = lower + lower.upper() + digits
    word = lambda: some(lower, rng.randint(3, 9))
    before = ""
    if kind == "email":
        a, d = rng.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[AT]", "[DOT]"), (" at ", " dot "), (" {at} ", "."), ("<at>", "<dot>")])
        if good:
            return kind, rng.choice(["", "mail ", "contact: ", "write to "]), word() + rng.choice(["", ".", "_"]) + word() + a + word() + d + rng.choice(["org", "com", "net", "de", "cz"]), True
        return kind, rng.choice(["", "look ", "arrive "]), rng.choice([f"{word()} (at) {some(digits, 2)}.{some(digits, 2)}", f"{word()} at {word()} dot {some(digits, 3)}", f"{word()} [at] {word()}.{some(digits, 4)}", f"{word()} at noon dot {some(lower, 9)}"]), False
    if kind == "ip":
        groups = [some(hexes, rng.randint(1, 4)) for _ in range(8)]
        if good:
            cut = rng.randint(1, 5)
            full, short = ":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 1 : rng.randint(cut + 2, 7)])
            return kind, rng.choice(["", "host ", "server ", "from ", "addr="]), rng.choice([full, short, short, "2001:db8::" + groups[0], "fe80::" + ":".join(groups[:4])]), True
        return kind, rng.choice(["", "class ", "namespace ", "at "]), rng.choice([f"{some('abcdef', 2)}::{some('abcdef', 3)}", f"{rng.randint(0, 23)}::{rng.randint(0, 59)}", "::", f"::{some('abcdef', 1)}", f"{some('abcdef', 1)}::"]), False
    if kind == "card":
        number = _luhn_tail(rng.choice("3456") + some(digits, rng.choice([12, 14, 14, 14, 15, 17])))
        if not good:
            number = number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)
            before = rng.choice(["", "isbn ", "order ", "ref ", "part "])
        else:
            before = rng.choice(["", "card ", "visa ", "pay with ", "account "])
        sep = rng.choice(["", " ", "-", ".", "/", "_", " - "])[:2]
        return kind, before, sep.join(number[i : i + 4] for i in range(0, len(number), 4)), good
    if kind == "phone":
        d = lambda n: some("23456789", 1) + some(digits, n - 1)
        if good:
            forms = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{d(2)}) {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(4)}"]
            form = rng.choice(forms)
            # A number without its area is one only where something says so.
            return kind, rng.choice(["call ", "phone ", "tel: "] if len(form) < 9 else ["", "", "call ", "phone ", "tel: ", "fax "]), form, True
        return kind, rng.choice(["", "on ", "date ", "page ", "pages ", "version ", "order ", "score "]), rng.choice([
            f"20{some(digits, 2)}-0{some(digits[1:], 1)}-1{some(digits, 1)}", f"1{some(digits, 1)}.0{some(digits[1:], 1)}.20{some(digits, 2)}", f"{rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)}",
            f"{rng.randint(10, 99)}.{rng.randint(10, 999)}.{rng.randint(10, 999)}", f"{some(digits, 2)}-{some(digits, 2)}-{some(digits, 2)}", f"{d(3)} {some(digits, 4)}", f"19{some(digits, 2)} 20{some(digits, 2)} 20{some(digits, 2)}",
        ]), False
    if good:
        named = rng.choice(["password=", 'token = "', "secret: ", "api_key=", "API_KEY=", "access key: ", "passwd ", "Bearer ", "pwd=", "credentials: ", "private_key = "])
        value = rng.choice([some(hexes, rng.choice([16, 18, 24, 32, 40, 64])), some(wide, rng.randint(8, 40)), some(wide, rng.randint(8, 24)) + "!" + some(digits, 2)])
        opaque = rng.choice(["AKIA", "ASIA", "ghp_", "sk-", "xoxb-", "AIza"]) + some(wide.upper() if rng.random() < 0.5 else wide, rng.choice([16, 16, 24, 35, 36]))
        return kind, *rng.choice([(named, value), (named, value), ("", opaque), ("key ", opaque)]), True
    return kind, *rng.choice([
        (rng.choice(["commit ", "sha1 ", "md5: ", "hash ", "revision "]), some(hexes, rng.choice([32, 40, 64]))), (rng.choice(["id ", "uuid "]), "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))),
        ("path ", f"{word()}/{word()}/{word()}-{some(digits, 4)}"), ("", f"{word()}-{word()}-{word()}-{some(digits, 2)}"), ("password ", rng.choice(["required", "protected", "must be changed", "strength"])),
        ("token ", word() + word()), ("secret ", rng.choice(["garden", "ballot", "agreement", "ingredient"])), ("", some(digits, rng.randint(20, 30))), ("", word() * 3 + some(digits, 2)),
    ]), False


def planted(carriers: list[str], count: int = SYNTHETIC, seed: int = 11) -> list[dict]:
    """Texts with one item each: text, kind, start and end (code points) and whether the item is a positive."""
    rng, out = random.Random(seed), []
    carriers = carriers or ["the quick brown fox jumps over the lazy dog and runs away from it"]
    for i in range(count):
        words = rng.choice(carriers).split() or ["so"]
        at = rng.randint(0, len(words))
        kind, before, item, good = _item(rng)
        head = " ".join(words[:at])
        head = (head + " " if head else "") + before
        text = head + item + rng.choice(["", '"', ".", ",", ")", " "]) + " " + " ".join(words[at:])
        out.append({"half": i % 2, "text": text, "kind": kind, "start": len(head), "end": len(head) + len(item), "good": good})
    return out


def train(docs: DataFrame, text: str = "text") -> Trees:
    """Fits on one half of the planted texts and calibrates thresholds on the other. Of ``docs`` only the carriers are read, chosen by a hash of doc_id and text."""
    spark = docs.sparkSession
    rows = docs.where(F.length(text) > 0).select(F.substring(F.col(text), 1, CARRIER_CHARS).alias("c"), F.xxhash64(F.col("doc_id"), F.lit(5)).alias("h"))
    carriers = [r.c for r in rows.orderBy("h", "c").limit(CARRIERS).collect()]
    form = "array<struct<half:int,text:string,kind:string,start:int,end:int,good:boolean>>"
    texts = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(planted(carriers))), form))).repartition(shuffle_partitions(spark))
    found, _, names = _candidates(texts.withColumnsRenamed({c: f"is_{c}" for c in ("kind", "start", "end", "good")}), "text", False)

    shared = "(least(x.`end`, is_end) - greatest(x.start, is_start))"
    length = "greatest(x.`end` - x.start, is_end - is_start)"
    # What lies beside the planted item is not known.
    each = [
        F.expr(f"transform(filter({n}, x -> {shared} > 0), x -> struct('{g[0]}' AS kind, is_good AND is_kind = '{g[0]}' AND {shared} >= 0.85 * {length} AS good, {_bits(g[0])} AS bits))")
        for n, g in zip(names, GENERATORS, strict=True)
    ]
    seen = found.select("half", F.explode(F.concat(*each)).alias("c")).select("half", "c.kind", "c.good", "c.bits")
    counts = seen.groupBy("half", "kind", "bits").agg(F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no")).collect()
    counts.sort(key=lambda r: (r.half, r.kind, r.bits))
    fit = [r for r in counts if r.half == 0]
    model = boost(np.array([r.bits for r in fit]).reshape(-1, len(BITS)), np.array([r.yes for r in fit]), np.array([r.no for r in fit]))
    for kind in KINDS:
        other = [r for r in counts if r.half == 1 and r.kind == kind]
        scores = model.of(np.array([r.bits for r in other]).reshape(-1, len(BITS)))
        order = np.argsort(-scores, kind="stable")
        yes = np.cumsum(np.array([r.yes for r in other])[order])
        both = yes + np.cumsum(np.array([r.no for r in other])[order])
        good = [i for i in range(len(order)) if yes[i] >= PRECISION * both[i]]
        # Combinations of equal score come and stay away together.
        ends = [i for i in good if i + 1 == len(order) or scores[order[i + 1]] < scores[order[i]]]
        if ends:
            i = ends[-1]
            model.thresholds[kind] = max(float(scores[order[i]]), 0.5)
            model.recall[kind], model.precision[kind] = float(yes[i] / yes[-1]), float(yes[i] / both[i])
    return model


def _passing(kind: str):
    return lambda x: passes(kind, x["text"])


def _selected(kind: str, model: Trees):
    return lambda c: model.probability(c["bits"]) >= model.thresholds[kind]


def _unwrapped(shape):
    return lambda c: shape(c["x"])


def find(docs: DataFrame, model: Trees, text: str = "text", base: str = "_base", spans: str = "_spans") -> DataFrame:
    """All rows and columns of ``docs`` with arrays of (kind, start, end, text) by kind, then start: the base spans and all selected spans, under the names ``base`` and ``spans``.

    Positions are code points, ends are exclusive. Null and empty texts have none; equal texts have equal spans; an empty table
    stays empty. Columns of ``docs`` that have one of the two names are replaced. A kind without a threshold selects no proposal."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (base.lower(), spans.lower())])
    rows, own, more = _candidates(docs, text, True)
    names = [F.col(f"`{c}`") for c in docs.columns]
    shape = lambda k: lambda x: F.struct(F.lit(KINDS.index(k)).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))
    certain, chosen = [], []
    for kind, name in zip(BASE_KINDS, own, strict=True):
        certain.append(F.transform(F.filter(F.col(name), _passing(kind)), shape(kind)))
    for (kind, _, _), name in zip(GENERATORS, more, strict=True):
        if kind in model.thresholds:
            known = F.expr(f"transform({name}, x -> struct(x AS x, {_bits(kind)} AS bits))")
            chosen.append(F.transform(F.filter(known, _selected(kind, model)), _unwrapped(shape(kind))))
    rows = rows.select(*names, F.concat(*certain).alias(own[0]), F.concat(F.array().cast("array<struct<k:int,start:int,end:int,text:string>>"), *chosen).alias(own[1]))
    rows = rows.select(*names, own[0], F.array_sort(F.concat(own[0], own[1])).alias(own[1]))
    # Of equal spans the first stays.
    single = F.filter(F.col(own[1]), lambda x, i: (i == 0) | (F.try_element_at(F.col(own[1]), F.greatest(i, F.lit(1))) != x))
    named = lambda c: F.transform(c, lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    return rows.select(*names, named(F.col(own[0])).alias(base), named(single).alias(spans))


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with each selected span of the text replaced by its kind in brackets. Of overlapping spans the first and longest counts."""
    base, spans = hidden(docs, "base"), hidden(docs, "spans")
    found = find(docs, model, text, base, spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        said = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct((-s["back"]).alias("at"), said.alias("out"))).otherwise(acc)

    done = F.aggregate(ordered, start, add, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).select(*docs.columns)
