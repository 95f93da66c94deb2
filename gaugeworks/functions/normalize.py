"""Text repair for drawing callouts, as Spark column expressions.

Each repair is a rule (pattern, replacement); a group of rules is folded over a
column in order.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM = r"[0-9]+(?:\.[0-9]+)?"
DASHES = "—–―‒‑‐−－"

# Spellings of symbols and the sign that each stands for, in the order they apply.
SYMBOLS = [
    (r"%%[cC]", "Ø"),
    (r"(?i)(?<![A-Za-z0-9_])(?:PHI|DIA)(?![A-Za-z0-9_])", "Ø"),
    ("[ø⌀Φφϕ]", "Ø"),
    ("[○◯OОo]\\s*°", "0°"),
    ("。", "°"),
    (r"(?i)(?<![A-Za-z0-9_])deg(?![A-Za-z0-9_])", "°"),
    ("[`′‘’]", "'"),
    ("[“”″]|''", '"'),
    (f"[{DASHES}]", "-"),
    (r"\+\s*[-/]\s*-?|±", "±"),
    (r"=\s*(?=[0-9])", "-"),
    (r"(?<=[0-9]),(?=[0-9])", "."),
]
# Fixed value: all that a callout may hold.
ALLOWED = r"0-9A-Za-zØ°'\"±+\-/.:,()\[\]□■ \t\n"


def fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_symbols(text: Column) -> Column:
    """Aliases of symbols to one spelling; dashes to ``-``, plus-minus spellings to ``±``, decimal commas to points."""
    return fold(text, SYMBOLS)


def whitelist(text: Column) -> Column:
    """Drops every character that no callout holds."""
    return F.regexp_replace(text, f"[^{ALLOWED}]", "")


#: What stands between two parts of a line and means nothing at its ends; the X of MAX is none.
_EDGES = r"^[/:.,xX\s]+|(?:[/:,\s]|(?<![A-Za-z])[xX])++$"
_INNER = [(r"[ \t]+", " "), (r"(?<=[0-9])\s*\.\s*(?=[0-9])", ".")]


def clean_lines(text: Column) -> Column:
    """Lines with a digit or a drawing letter, without separators at their ends, blanks squeezed, decimals closed up."""
    told = F.filter(F.split(text, "\n"), lambda line: line.rlike("(?i)[0-9Ø°RCDMX□■]"))
    kept = F.transform(told, lambda line: F.trim(fold(line, [(_EDGES, ""), *_INNER])))
    return F.array_join(F.filter(kept, lambda line: line != ""), "\n")


def sanitize(text: Column) -> Column:
    return clean_lines(whitelist(normalize_symbols(text)))


def replace_characters(text: Column, replacements: dict[str, str]) -> Column:
    """Learned literal replacements, in order."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), text)


# ---- damaged numbers
#
# A text is cut once into numbers and what stands between them, by turns.  Each piece is then judged by its neighbours: a gap
# between two numbers goes, becomes a point or stays; a number behind a sign gets back the point that it has lost.

_PIECE = rf"({NUM}|[^0-9]+)"
_WHOLE, _DECIMAL = "^[0-9]+$", r"^[0-9]+\.[0-9]+$"
#: A letter where a zero belongs: before a point (the C of a chamfer may stand before it), behind one, or alone behind a sign.
_ZERO_LETTER = r"(?<![A-Za-z0-9_])[oO](?=\.)|(?<=(?<![A-Za-z0-9_])C)[oO](?=\.)|(?<=[0-9]\.)[oO](?=[0-9])|(?<=[+-])[oO](?![A-Za-z0-9_])"
#: A sign behind its number.
_LATE_SIGN = rf"(?<![0-9.])({NUM})\s*([-+])(?=\s|$)"
_SPELLING = [(_ZERO_LETTER, "0"), (r"(?<=[0-9]):(?=[0-9])", "."), (r"(?<=[0-9]\s{0,4}-\s{0,4})8(?=\.)", "0"), *_INNER[1:], (r"(?m)^°\s*", "0\n"), (r"\s+°(?=[0-9A-Za-z])", " 0"), (_LATE_SIGN, "$2$1")]
#: Dashes and the like at the ends of a line lead to something on the sheet; a minus before a zero is a sign.
_LEADER = r"^[-_~|^/=\s]+(?<!-(?=0))|[-_~|^/=\s]+$"
#: Blanks inside a run of whole numbers that a tolerance follows; a zero at the start or before a sign is a zero line and stays apart.
_RUN = r"(?<![.][0-9]{1,6})(?<=[0-9])(?<!^0)[ ]+(?=(?!0[ ]*[-+])[0-9]++(?:[ ]++[0-9]++)*+\s*+(?:±|[-+]\s*[0-9]))"


def _gap(pieces: Column, here: Column, i: Column) -> Column:
    """What becomes of a piece between two numbers: nothing, a point, or itself."""
    at = lambda k: F.coalesce(F.get(pieces, i + k), F.lit(""))
    left, right, before, behind, next_ = at(-1), at(1), F.when(i < 2, "").otherwise(at(-2)), at(2), at(3)
    blank, apart = here.rlike("^[ \t]+$"), ~before.rlike(r"[-+±.]\s*$")
    # is what follows a tolerance, a zero line or the end?
    ends = lambda sep, number: sep.rlike(r"^\s*[-+±]") | sep.rlike(r"^\s+$") & F.startswith(number, F.lit("0")) | (F.trim(sep) == "") & (number == "")
    closed = ends(behind, next_)
    digit, pair = lambda x: x.rlike("^[1-9]$"), lambda x: x.rlike("^[0-9]{2}$")
    # a digit, a digit and two decimals
    first = digit(left) & right.rlike("^[0-9]$") & pair(next_) & behind.rlike("^[ \t]+$") & ends(at(4), at(5))
    second = left.rlike("^[0-9]$") & pair(right) & before.rlike("^[ \t]+$") & digit(F.when(i < 3, "").otherwise(at(-3))) & closed
    cut = left.rlike("^[1-9][0-9]*$") & pair(right) & apart & closed
    more = left.rlike(_DECIMAL) & right.rlike("^[1-9][0-9]{0,2}$") & apart & closed
    tens = digit(left) & right.rlike(r"^[0-9]\.[0-9]+$") & ~before.rlike(r"\.$") & closed
    # a dash where the point was
    dash = here.rlike(r"^(?:-\s*|\s+-\s+|\s*[~_]\s*)$") & left.rlike("^[1-9][0-9]*$") & ~before.rlike(r"\.$") & right.rlike(_WHOLE)
    signed = behind.rlike(r"^\s*[-+±]") | behind.rlike(r"^\s+$") & next_.rlike(r"^0(\.0*)?$") & at(4).rlike(r"^\s*[-+]")
    dash &= right.rlike("^0[0-9]") | here.rlike("[~_]") | signed
    return F.when(blank & (first | more | tens), "").when(blank & (second | cut) | dash, ".").otherwise(here)


def _joined(text: Column) -> Column:
    """Numbers that blanks have cut apart, or a dash instead of the point."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    return let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: F.when(x.rlike("^[0-9]"), x).otherwise(_gap(p, x, i))), ""))


def _pointed(text: Column) -> Column:
    """Tolerances that have lost their point.

    Behind a zero line (``0``, ``0.0``) a small whole number counts in the last
    place of the zero, or of the nominal if the zero has none.  Elsewhere one
    digit and as many zeros as the other tolerances have places stands for that
    place, read from either end.
    """
    digits = F.when(text.rlike(r"0\.00[0-9]"), 3).when(text.rlike(r"0\.0[0-9]"), 2).otherwise(0)

    def body(p: Column) -> Column:
        at = lambda i, k: F.when(i + k < 0, "").otherwise(F.coalesce(F.get(p, F.greatest(i + k, F.lit(0))), F.lit("")))
        places = lambda x: F.length(F.regexp_extract(x, r"\.([0-9]+)$", 1))

        def zeros(i: Column) -> Column:
            """Of the number at ``i``, if it is a tolerance behind a zero line: how many zeros follow its point; else null."""
            number, sign, zero, nominal = at(i, 0), at(i, -1), at(i, -2), at(i, -4)
            own, outer = places(zero), places(nominal)
            small = sign.rlike(r"^\s*[-+]\s*$") & zero.rlike(r"^0(\.0+)?$") & at(i, -3).rlike(r"^\s*[-+]?$|\s[-+]?$|^$")
            return F.when(small & (own > 0) & number.rlike("^[1-9][0-9]?$"), own).when(small & (own == 0) & number.rlike("^[1-9]$") & outer.isin(2, 3) & at(i, -3).rlike(r"^\s*[-+]?$"), outer - 1)

        def one(x: Column, i: Column) -> Column:
            own, next_, later = zeros(i), zeros(i + 2), zeros(i + 3)
            signed = at(i, -1).rlike(r"[-+]$")
            bare = F.replace(x, F.lit("0"), F.lit(""))
            lost = signed & x.rlike("^(?:0+[1-9]|[1-9]0+)$") & (F.length(x) == digits + 1) & bare.rlike("[123458]") & ((digits == 3) | bare.isin("1", "2", "5"))
            number = F.when(own.isNotNull(), F.concat(F.lit("0."), F.repeat(F.lit("0"), own), x)).when(next_.isNotNull(), "0").when(lost, F.concat(F.lit("0."), F.repeat(F.lit("0"), digits - 1), bare)).otherwise(x)
            sep = F.when(zeros(i + 1).isNotNull(), F.concat(F.lit(" "), F.trim(x))).when(later.isNotNull(), F.regexp_replace(x, r"^(.*?)\s*[-+]?$", "$1 ")).otherwise(x)
            return F.when(x.rlike("^[0-9]"), number).otherwise(sep)

        return F.array_join(F.transform(p, one), "")

    return let(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)), body)


def repair_numbers(text: Column) -> Column:
    """Undoes what scanning does to numbers: lost points, cut digits, signs behind, letters for zeros."""
    led = lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda line: F.regexp_replace(line, _LEADER, "")), "\n")
    return let(let(let(fold(text, _SPELLING), _joined), _pointed), lambda t: F.regexp_replace(led(t), _RUN, ""))


def clean_ocr(text: Column) -> Column:
    """:func:`sanitize`, then leader dashes and cut numbers line by line."""
    one = lambda line: _joined(fold(line, [(_LEADER, ""), (_ZERO_LETTER, "0")]))
    return F.array_join(F.filter(F.transform(F.split(sanitize(text), "\n"), one), lambda line: line != ""), "\n")


def masked_key(key: Column) -> Column:
    """A secret key as it may be shown: its first six and last four characters if it has more than twelve, else none."""
    return F.when(F.length(key) > 12, F.concat(F.substring(key, 1, 6), F.lit("•" * 8), F.substring(key, -4, 4))).otherwise("•" * 12)


def join_cad_tokens(text: Column) -> Column:
    """A plus apart from its number, and ``n-0 m`` for a nominal with a zero line above a minus tolerance."""
    return fold(text, [(r"\+\s+(?=[0-9])", "+"), (rf"({NUM})-0\s+({NUM})", "$1 0 -$2")])
