"""Column expressions that read attribute-value parameters however they were written.

All of these are built-in expressions, so they stay inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the sources use it (Java's \s has no no-break space).
BLANK = r"[\s   ]"
#: Texts that stand for "nothing was recorded".
PLACEHOLDERS = ["unknown", "not set", "nan?", "nan", "--", "-", "n/a", "na", "#ref", "#ref!", "pending", "null", "none", "tbd", "?"]
#: Usual spellings of the two truth values.
TRUE_TEXTS = ["true", "t", "yes", "y", "on", "1", "1.0"]
FALSE_TEXTS = ["false", "f", "no", "n", "off", "0", "0.0"]

_NUMBER = r"[+-]?(?:\d+(?:[.,]\d+)*\.?|[.,]\d+)(?:[eE][+-]?\d+)?"
_NUMBER_AND_TAIL = rf"^({_NUMBER}){BLANK}*[\[(]?{BLANK}*([^\d\[\]()]*?){BLANK}*[\])]?$"


def squeeze(c: Column) -> Column:
    """Outer blanks cut, inner runs of blanks as one space."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def filled(c: Column) -> Column:
    """Null where the text is null or blank."""
    return F.nullif(squeeze(c), F.lit(""))


def canonical_curie(c: Column) -> Column:
    """``ms_1000016``, `` MS:1000016`` and ``UO:28`` as ``MS:1000016`` and ``UO:0000028``; null if it is no CURIE."""
    padded = F.regexp_replace(F.upper(squeeze(c)), r"^([A-Z]+)[:_ ]0*(\d{1,7})$", "$1:000000$2")
    odd = F.regexp_substr(F.regexp_replace(padded, r"^([A-Z]+):0*(\d{7})$", "$1:$2"), F.lit(r"^[A-Z]+:\d{7}$"))
    return F.when(c.rlike(r"^[A-Z]+:\d{7}$"), c).otherwise(odd)  # most are written in full: one match and no rewriting


def bare_name(c: Column) -> Column:
    """A parameter name without CV inflection and without a unit written behind it."""
    s = F.regexp_replace(squeeze(c), r"^[A-Za-z]+_\d+_", "")
    s = F.regexp_replace(s, r"_unit(_[A-Za-z]+_\d+)?$", "")
    return F.regexp_replace(s, r"\s*(\([^()]*\)|\[[^\[\]]*\]|,[^,]*)$", "")


def name_key(c: Column) -> Column:
    """Letters and digits of the bare name in lower case: what all spellings of one attribute share."""
    return F.regexp_replace(F.lower(bare_name(c)), r"[^a-z0-9]+", "")


def unit_in_name(c: Column) -> Column:
    """The unit label told by a name: an inflected ``..._unit_UO_0000028``, or ``(ms)``, ``[ms]``, ``, ms`` at its end."""
    told = F.regexp_substr(squeeze(c), F.lit(r"(_unit_[A-Za-z]+_\d+|\([^()]*\)|\[[^\[\]]*\]|,[^,]*)$"))
    return filled(F.regexp_replace(told, r"^(_unit_|[(\[,])|[)\]]$", ""))


def unit_in_text(c: Column) -> Column:
    """The unit label behind the number of a value's text; null if there is none."""
    # a bare number has none, and what doesn't begin like a number is none
    return F.when(c.rlike(rf"^{BLANK}*[+-]?[.,]?\d.*[^\d.]"), filled(F.regexp_extract(squeeze(c), _NUMBER_AND_TAIL, 2)))


def _number_text(c: Column) -> Column:
    """The digits of the number a text holds, with a decimal point at most; null or empty if it holds none."""
    t = F.regexp_extract(squeeze(c), _NUMBER_AND_TAIL, 1)
    plain = F.translate(F.regexp_replace(t, r",(?=.*[.,])|(?<=,.{1,40}),|\.(?=.*[.,])|(?<=\..{1,40})\.", ""), ",", ".")
    one_sign = F.when(t.rlike(r"^[^.,]*\.?[^.,]*$"), t).otherwise(plain)  # most have no sign to be told
    # a bare number needs none of this; other texts are tried only if they begin like one
    return F.when(c.rlike(r"^[+-]?\d{1,17}(\.\d{1,17})?$"), c).when(c.rlike(rf"^{BLANK}*[+-]?[.,]?\d"), one_sign)


def number_in_text(c: Column) -> Column:
    """The number a text holds, with or without a unit behind it; null if it holds none.

    With both signs the later one is the decimal sign; one comma alone is a decimal comma; a sign that
    occurs several times separates thousands.
    """
    value = _number_text(c).try_cast("double")
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))  # too long for a double: no number


def whole_of(value: Column) -> Column:
    """The number in any slot of a parameter value as an exact bigint; a fraction is rounded, halves away from zero.

    Whole numbers never go through a double. Null if the number is beyond a bigint.
    """
    f, t = value["float"], _number_text(value["string"])
    fine = F.when(~F.isnan(f) & (F.abs(f) != float("inf")), f)
    text = F.coalesce(t.try_cast("bigint"), F.round(t.try_cast("decimal(38,9)"), 0).try_cast("bigint"), F.round(t.try_cast("double")).try_cast("bigint"))
    return F.when(value["integer"].isNotNull(), value["integer"]).when(fine.isNotNull(), F.round(fine).try_cast("bigint")).otherwise(text)


def is_placeholder(c: Column) -> Column:
    return F.lower(squeeze(c)).isin(PLACEHOLDERS)


def number_of(value: Column) -> Column:
    """The number in any slot of a parameter value; not-a-number and infinities are none, booleans are none."""
    f = value["float"]
    fine = F.when(~F.isnan(f) & (F.abs(f) != float("inf")), f)
    return F.coalesce(value["integer"].cast("double"), fine, number_in_text(value["string"]))


def boolean_of(value: Column) -> Column:
    s = F.lower(squeeze(value["string"]))
    i, f = value["integer"], value["float"]
    return F.coalesce(
        value["boolean"],
        F.when(i == 1, True).when(i == 0, False),
        F.when(f == 1, True).when(f == 0, False),
        F.when(s.isin(TRUE_TEXTS), True).when(s.isin(FALSE_TEXTS), False),
    )


def text_of(value: Column) -> Column:
    """Text that is neither blank nor a placeholder, else the written form of the first filled slot."""
    s = value["string"]
    kept = F.when((squeeze(s) != "") & ~is_placeholder(s), s)
    f = value["float"]
    return F.coalesce(kept, value["integer"].cast("string"), F.when(~F.isnan(f), f).cast("string"), value["boolean"].cast("string"))


def value_text(value: Column) -> Column:
    """First filled slot in struct order, as text."""
    return F.coalesce(value["integer"].cast("string"), value["float"].cast("string"), value["string"], value["boolean"].cast("string"))
