"""Scalar functions as Column expressions, so they stay inside generated code."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces that count as plain ones, cell texts that stand for no number.
ODD_SPACES = "\u00a0\u202f\u2007\u2009"
NO_NUMBER = ["", "-", "—", "х", "x", "*", "нет", "н/д"]
FAR_YEARS = 51


def clean(c: Column) -> Column:
    """null as '', odd spaces and the en dash made plain, white space collapsed and trimmed."""
    plain = F.translate(F.coalesce(c.cast("string"), F.lit("")), ODD_SPACES + "–", " " * len(ODD_SPACES) + "-")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


#: Private letters that stand for what others decompose into, from this one on.
FIRST_CODE = 0xE000


@lru_cache(maxsize=1)
def _decomposed() -> tuple[str, str, str]:
    """All lower-case characters but й that decompose (NFKD) into some digit or letter, the private letter of what each leaves, and what each such letter stands for, after one tab each. Private letters of a text itself leave a space."""
    found = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1FC00)]):
        left = re.sub("[^0-9a-zа-я]", " ", unicodedata.normalize("NFKD", c))
        if left.strip() and left != c and c != "й":
            found[c] = left
    listed = sorted(set(found.values()))
    code = {left: chr(FIRST_CODE + k) for k, left in enumerate(listed)}
    own = "".join(code.values())
    return "".join(found) + own, "".join(code[x] for x in found.values()) + " " * len(own), "\t".join(listed)


def norm_key(c: Column) -> Column:
    """lower case, ё as е, characters decomposed (й as и and a break, ½ as 1 and 2), everything but digits and letters a space."""
    out = F.replace(F.replace(F.lower(clean(c)), F.lit("ё"), F.lit("е")), F.lit("й"), F.lit("и "))
    odd, codes, parts = _decomposed()
    coded = f"[{chr(FIRST_CODE)}-{chr(FIRST_CODE + parts.count(chr(9)))}]"
    one = lambda x: F.coalesce(F.get(F.split(F.lit(parts), "\t"), F.ascii(x) - FIRST_CODE), x)
    # a translation looks letters up by hash, then only the few pieces at coded letters are looked at
    full = F.concat_ws("", F.transform(F.split(F.translate(out, odd, codes), f"(?={coded})|(?<={coded})"), one))
    full = F.when(F.regexp_like(out, F.lit("[^\u0000-\u007fа-я–—«»„“”’…№]|№")), full).otherwise(out)
    return F.trim(F.regexp_replace(full, "[^0-9a-zа-я]+", " "))


def parse_number(c: Column) -> Column:
    """the first number of a cell, with a comma or a point; sentinels are null."""
    text = F.lower(clean(c))
    digits = F.regexp_extract(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), r"-?\d+(\.\d+)?", 0)
    return F.when(~text.isin(NO_NUMBER), F.nullif(digits, F.lit("")).try_cast("double"))


def parse_year(c: Column) -> Column:
    """the first year of 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(clean(c), r"(19|20)\d{2}", 0), F.lit("")).cast("int")


def parse_date(c: Column) -> Column:
    """d.m.yyyy with . - or / and yyyy-mm-dd as ISO text."""
    text, day = clean(c), r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    part = lambda k: F.lpad(F.regexp_extract(text, day, k), 2, "0")
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    return F.when(iso != "", iso).when(F.regexp_like(text, F.lit(day)), F.concat_ws("-", F.regexp_extract(text, day, 3), part(2), part(1)))


def year_bounds(period: Column, date_from: Column, date_to: Column, act_date: Column) -> tuple[Column, Column, Column]:
    """year, first and last year; an explicit year fills what dates leave open."""
    year = parse_year(period)
    of = lambda c: F.substring(parse_date(c), 1, 4).cast("int")
    start = F.coalesce(of(date_from), year, of(act_date))
    end = F.coalesce(of(date_to), F.when(of(date_from).isNull(), year))
    return year, start, end


def near_end(year_to: Column, today: Column) -> Column:
    """an end too far away is none."""
    return F.when(year_to <= today + FAR_YEARS, year_to)


def name_key(c: Column) -> Column:
    """F8: a region's key without the words for its kind."""
    bare = F.regexp_replace(norm_key(c), "^((республика|город|г|область|краи) )+", "")
    return F.trim(F.regexp_replace(bare, "( (республика|область|краи|автономная область|автономныи округ))+$", ""))


def object_group(c: Column) -> tuple[Column, Column]:
    """what stands before the first colon, and the rest."""
    text = clean(c)
    return F.trim(F.substring_index(text, ":", 1)), F.when(F.instr(text, ":") > 0, F.trim(F.regexp_extract(text, "^[^:]*:(.*)$", 1)))


def benefit_kind(amount: Column, unit: Column) -> Column:
    """exemption, reduced rate or an amount in a unit."""
    n, u = parse_number(amount), clean(unit)
    shown = F.regexp_replace(F.format_string("%s", n), r"\.0$", "")
    share = (u == "") | u.contains("%")
    return F.when(n.isNull(), "").when(share & (n >= 100), "Освобождение от уплаты").when(share, F.concat(F.lit("Пониженный размер: "), shown, F.lit(" %"))).otherwise(F.concat(F.lit("Льгота: "), shown, F.lit(" "), u))


def payer_flags(attrs: Column) -> dict[str, Column]:
    """flags of a record's attributes; of several spellings the first that is there counts."""
    spelled = {"fl": ["Fl", "FL", "fl"], "ul": ["UL", "Ul", "ul", "Yur"], "ip": ["IP", "Ip", "ip"]}
    return {k: F.coalesce(F.coalesce(*(F.try_element_at(attrs, F.lit(x)) for x in v)).isin("1", "true", "True", "да", "Да"), F.lit(False)).cast("int") for k, v in spelled.items()}


def payer_from_flags(fl: Column, ul: Column, ip: Column) -> Column:
    """the only payer, or all."""
    return F.when(fl + ul + ip != 1, "all").when(fl == 1, "fl").when(ul == 1, "ul").otherwise("ip")


def flags_for(payer: Column) -> list[Column]:
    return [F.coalesce((payer == k).cast("int"), F.lit(0)).alias(f"for_{k}") for k in ("fl", "ul", "ip")]


def tokenize(c: Column) -> Column:
    """lower-case words of more than one character, with hyphens inside."""
    words = F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit("[а-яa-z0-9][а-яa-z0-9-]*"), F.lit(0))
    return F.filter(words, lambda w: F.length(w) > 1)


def slug(section: Column, group: Column, name: Column) -> Column:
    """a stable name of an indicator."""
    bare = lambda c: F.replace(norm_key(c), F.lit(" "), F.lit("-"))
    return F.substring(F.concat(F.lit("s"), section, F.lit("--"), F.when(F.coalesce(group, F.lit("")) != "", F.concat(bare(group), F.lit("--"))).otherwise(""), bare(name)), 1, 180)
