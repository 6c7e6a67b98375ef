"""Text functions, Column to Column. None uses a Python worker."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: The standard's named references; of these, those that need no semicolon; and the characters of numbers 128 to 159.
_NAMED = dict(html5)
_LEGACY = [n for n in html5 if not n.endswith(";")]
_WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]


def ws_normalise(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_form(c: Column) -> Column:
    """Lower case, with a space for each run of anything but a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def text_hash(c: Column) -> Column:
    """First 12 hex digits of the sha256 of the text with normal white space."""
    return F.substring(F.sha2(ws_normalise(c).cast("binary"), 256), 1, 12)


def html_unescape(c: Column, open_names: tuple[str, ...] | None = None) -> Column:
    """All character references of HTML as their characters: named ones (the standard's table, those that need no semicolon too), decimal
    and hexadecimal ones. Numbers of the old Windows page stand for its characters, numbers of no character for U+FFFD or nothing.
    With `open_names` these names alone need no semicolon; other names, and numbers, do."""
    known = {n: x for n, x in _NAMED.items() if open_names is None or n.endswith(";") or n in open_names}
    number = "^&#(?:[0-9]|[xX][0-9A-Fa-f])" if open_names is None else "^&#(?:[0-9]+|[xX][0-9A-Fa-f]+);"
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    longest = max(map(len, _LEGACY))

    def numbered(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?([0-9A-Fa-f]+)", 1)
        stripped = F.regexp_replace(digits, "^0+(?=.)", "")
        base16 = x.rlike("^&#[xX]")
        code = F.when(F.length(stripped) > 8, F.lit(1 << 24)).otherwise(F.when(base16, F.conv(stripped, 16, 10)).otherwise(stripped).cast("bigint"))
        old = F.get(F.array(*map(F.lit, _WINDOWS)), (code - 128).cast("int"))
        bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0)
        nothing = (code < 32) & ~code.isin(9, 10, 12, 13) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(65536)) >= 65534)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        put = F.when(code.between(128, 159), old).when(code == 13, "\r").when(bad, "\ufffd").when(nothing, "").otherwise(char)
        return F.concat(put, F.regexp_replace(x, "^&#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", ""))

    def named(x: Column) -> Column:
        word = F.regexp_extract(x, "^&([A-Za-z][A-Za-z0-9]{0,31};?)", 1)
        beginnings = F.transform(F.sequence(F.lit(0), F.lit(longest - 2)), lambda k: F.substring(word, 1, F.lit(longest) - k))
        held = F.get(F.filter(F.array_prepend(F.array_distinct(beginnings), word), lambda w: F.element_at(names, w).isNotNull()), 0)
        return F.when(held.isNull(), x).otherwise(F.concat(F.element_at(names, held), F.substring(x, F.length(held) + 2, F.length(x))))

    def one(x: Column) -> Column:
        return F.when(x.rlike(number), numbered(x)).when(x.rlike("^&[A-Za-z]"), named(x)).otherwise(x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)", -1), one), "")).otherwise(c)


def number_forms(c: Column) -> Column:
    """The ways a figure from 0.0001 to under a million is written: shortest form of six significant digits, one decimal, two decimals."""
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(c)))).cast("int")
    exact = c.cast("decimal(38,12)")
    rounded = F.coalesce(*(F.when(digits == k, F.bround(exact, k).cast("decimal(38,12)").cast("string")) for k in range(10)))
    short = F.when(c == 0, "0").otherwise(trimmed(rounded))

    def fixed(places: int) -> Column:
        """The exact binary figure rounded: where twice the scaled figure is an odd number, what the product lost tells the side."""
        scale = 2 * 10**places
        high = 134217729.0 * c - (134217729.0 * c - c)
        twice = c * scale
        lost = (high * scale - twice) + (c - high) * scale
        near = F.when((F.abs(twice % 2) == 1) & (lost != 0), (twice + F.signum(lost)) / 2).otherwise(F.bround(exact, places).cast("double") * (scale // 2))
        return (F.rint(near).cast("decimal(30,0)") / F.lit(scale // 2)).cast(f"decimal(32,{places})").cast("string")

    return F.array(short, fixed(1), fixed(2))


def pdf_links(html: Column) -> Column:
    """Distinct links to PDFs of a page, in order: href, else src, else data of a, iframe, embed and object tags."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:a|iframe|embed|object)\b[^>]*>"), F.lit(0))

    def link(tag: Column) -> Column:
        found = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1) for name in ("href", "src", "data")]
        return F.coalesce(*(F.when(x != "", x) for x in found))

    return F.array_distinct(F.filter(F.transform(tags, link), lambda x: F.contains(F.lower(x), F.lit(".pdf"))))


def spans(c: Column, pattern: str) -> Column:
    """[start, end) of all matches, in code points from 0: the lengths of what lies between matches, and of the matches."""
    gaps, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["gap"])
        e = s + F.length(z["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(c.rlike(pattern), F.aggregate(both, start, step)["out"]).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def part(c: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive, from 0)."""
    return F.substring(c, start + 1, F.greatest(end - start, F.lit(0)))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def words_between(c: Column, a: Column, b: Column) -> Column:
    """Words between two spans of `c`; 0 where they touch or overlap. Of many spans of one text, see `marked_spans`."""
    gap = F.when(b["s"] >= a["e"], part(c, a["e"], b["s"])).when(a["s"] >= b["e"], part(c, b["e"], a["s"]))
    return F.when(gap.isNull(), 0).otherwise(n_words(gap))


def gaps_and_hits(c: Column, pattern: str, there: Column | None = None) -> Column:
    """(gaps, hits): what lies between the matches of a pattern, and the matches; both empty without one. Where it is known whether there are
    matches, or whether they matter, `there` says so and the text isn't searched for it."""
    none, there = F.array().cast("array<string>"), c.rlike(pattern) if there is None else there
    return F.struct(
        F.when(there, F.split(c, pattern, -1)).otherwise(none).alias("gaps"),
        F.when(there, F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(none).alias("hits"),
    )


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def marked_spans(gaps: Column, hits: Column) -> Column:
    """(s, e, ws, we, negated) of each match, in one fold over what `gaps_and_hits` found, which reads each character once.

    s and e are code points. ws counts the words that begin before s; we those that begin before e, less one that goes on at e: so
    the words between two spans are a difference of the two (`words_apart`). negated: one of the last three words before the
    match is a negator; the fold carries these three words along."""
    n = F.size(hits)
    runs = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0)))
    begins, ends = (lambda x: x.rlike(r"(?U)^\S")), (lambda x: x.rlike(r"(?U)\S\z"))
    follows = F.zip_with(F.slice(gaps, 2, n), F.slice(hits, 2, n), lambda g, h: F.when(g != "", g).otherwise(F.coalesce(h, F.lit(""))))
    both = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    pieces = F.zip_with(both, follows, lambda x, after: F.struct(
        F.lower(x["g"]).alias("gap"), F.lower(x["h"]).alias("hit"), F.length(x["g"]).alias("n_gap"), F.length(x["h"]).alias("n_hit"),
        runs(x["g"]).alias("gap_runs"), runs(x["h"]).alias("hit_runs"), begins(x["g"]).alias("gap_begins"), ends(x["g"]).alias("gap_ends"),
        begins(x["h"]).alias("hit_begins"), ends(x["h"]).alias("hit_ends"), begins(after).alias("goes_on"),
    ))
    one = lambda on: F.when(on, 1).otherwise(0)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit(False).alias("open"), F.lit("").alias("tail"),
        F.array().cast("array<struct<s:int,e:int,ws:int,we:int,negated:boolean>>").alias("out"),
    )

    def step(acc: Column, z: Column) -> Column:
        s = acc["at"] + z["n_gap"]
        ws = acc["words"] + z["gap_runs"] - one(acc["open"] & z["gap_begins"])
        is_open = F.when(z["n_gap"] == 0, acc["open"]).otherwise(z["gap_ends"])
        words = ws + z["hit_runs"] - one(is_open & z["hit_begins"])
        last = lambda x: F.slice(F.reverse(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0))), 1, 3)

        def found(x: Column) -> Column:
            span = F.struct(
                s.alias("s"), (s + z["n_hit"]).alias("e"), ws.alias("ws"), (words - one(z["hit_ends"] & z["goes_on"])).alias("we"),
                F.arrays_overlap(x["last"], F.array(*map(F.lit, P.NEGATORS))).alias("negated"),
            )
            tail = F.concat(F.array_join(F.reverse(x["last"]), " "), F.when(x["part"], "").otherwise(" "), z["hit"])
            return F.struct(
                (s + z["n_hit"]).alias("at"), words.alias("words"), F.when(z["n_hit"] == 0, is_open).otherwise(z["hit_ends"]).alias("open"),
                tail.alias("tail"), F.array_append(acc["out"], span).alias("out"),
            )

        before = _let(F.concat(acc["tail"], z["gap"]), lambda x: F.struct(last(x).alias("last"), x.rlike(r"(?U)\w\z").alias("part")))
        return _let(before, found)

    return F.aggregate(pieces, start, step)["out"]


def words_apart(a: Column, b: Column) -> Column:
    """`words_between` of two marked spans of one text."""
    return F.when(b["s"] > a["e"], b["ws"] - a["we"]).when(a["s"] > b["e"], a["ws"] - b["we"]).otherwise(0)


def sentences(c: Column) -> Column:
    """The sentences of a paragraph: inline bullets and numbers part it; stops of abbreviations and initials don't."""
    parts = F.split(c, P.INLINE_BULLET, -1)

    def cut(x: Column) -> Column:
        x = F.regexp_replace(x, P.MID_NUMBER, " ")
        x = F.regexp_replace(x, P.ABBREVIATION, "$1" + P.STAND_IN)
        x = F.regexp_replace(x, P.INITIAL, "$1" + P.STAND_IN)
        return F.split(x, P.SENTENCE_END, -1)

    clean = F.transform(F.flatten(F.transform(parts, cut)), lambda s: F.regexp_replace(F.replace(s, F.lit(P.STAND_IN), F.lit(".")), r"(?U)^\s+|\s+$", ""))
    return F.filter(clean, lambda s: s != "")


def sentences_simple(c: Column) -> Column:
    """The sentences of pasted text, by a shorter list of abbreviations."""
    c = ws_normalise(F.coalesce(c, F.lit("")))
    for word in P.SHORT_ABBREVIATIONS:
        c = F.replace(c, F.lit(word), F.lit(word.replace(".", "<DOT>")))
    return F.filter(F.transform(F.split(c, P.SHORT_END, -1), lambda s: F.trim(F.replace(s, F.lit("<DOT>"), F.lit(".")))), lambda s: s != "")


def is_decision(c: Column) -> Column:
    """Whether a sentence announces the rate decision of the statement's own bank."""
    other = c.rlike(P.OTHER_BANKS) & ~F.contains(F.lower(c), F.lit("committee"))
    acted = (c.rlike(P.ACTION) & c.rlike(P.ANNOUNCE)) | c.rlike(P.DIRECT_ACTION) | c.rlike(P.IMPERATIVE)
    return ~other & (c.rlike(P.ANNOUNCED_RATE) | (c.rlike(P.RATE_TERM) & acted))


def doc_type(title: Column) -> Column:
    t = F.lower(title)
    has = lambda w: F.contains(t, F.lit(w))
    support = has(P.SUPPORT_WORDS[0])
    for w in P.SUPPORT_WORDS[1:]:
        support = support | has(w)
    return (
        F.when(has("transcript"), "transcript").when(F.startswith(t, F.lit("notice")), "notice").when(has("highlights"), "highlights")
        .when(has("emergency"), "emergency").when(support, "support_data").when(has("mpc press release"), "press_release")
        .when(F.startswith(t, F.lit("mpc meeting")), "meeting_notice").otherwise("other")
    )


def section_hint(heading: Column) -> Column:
    hits = [F.when(heading.rlike("(?iU)" + p), F.lit(name)) for name, p in P.SECTION_HINTS]
    return F.coalesce(*hits, F.lit(""))


def _month_number(name: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, P.MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(place > 0, place.cast("int"))


def letterhead_date(c: Column) -> Column:
    """The date after 'committee' or 'release' in the first 400 characters; null if none or not a date."""
    head = F.substring(ws_normalise(c), 1, 400)
    get = lambda i: F.regexp_extract(head, P.LETTERHEAD_DATE, i)
    text = F.format_string("%s-%02d-%02d", get(3), _month_number(get(1)), get(2).try_cast("int"))
    return F.when(head.rlike(P.LETTERHEAD_DATE), F.try_to_date(text, "yyyy-MM-dd"))


def meeting_number(c: Column) -> Column:
    """The first ordinal from 1 to 140 of the first 1,500 characters with a word for a meeting close to it."""
    head = F.substring(ws_normalise(c), 1, 1500)

    def near(x: Column) -> Column:
        from_, to = F.greatest(x["s"] - 60, F.lit(0)), x["e"] + 80
        window = F.lower(part(head, from_, to))
        hit = F.contains(window, F.lit(P.ORDINAL_NEIGHBOURS[0]))
        for w in P.ORDINAL_NEIGHBOURS[1:]:
            hit = hit | F.contains(window, F.lit(w))
        return hit

    number = lambda x: F.regexp_extract(part(head, x["s"], x["e"]), r"(\d{1,3})", 1).cast("int")
    good = F.filter(F.transform(F.filter(spans(head, P.ORDINAL), near), number), lambda n: n.between(1, 140))
    return F.get(good, 0)


def title_month(title: Column, full_names: bool = False) -> Column:
    """First day of the month that a title names; null if none."""
    p = P.FULL_TITLE_MONTH if full_names else P.TITLE_MONTH
    return F.when(title.rlike(p), F.make_date(F.regexp_extract(title, p, 2).cast("int"), _month_number(F.regexp_extract(title, p, 1)), F.lit(1)))


def rates_near_mentions(c: Column, mention: str = P.RATE_MENTION, reach: int = 250) -> Column:
    """Distinct percent figures within `reach` characters from a mention, sorted."""
    t = ws_normalise(c)
    found = F.flatten(F.transform(spans(t, mention), lambda x: F.regexp_extract_all(part(t, x["s"], x["s"] + reach), F.lit(P.PERCENT), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def level(c: Column) -> Column:
    """The first stated inflation level of a sentence, between 0 and 100 and not a target; null if none, or if it is to be skipped."""
    whole = spans(c, P.LEVEL)

    def value(x: Column) -> Column:
        hit = part(c, x["s"], x["e"])
        tail = F.regexp_extract(hit, r"(?iU)(\d{1,2}(?:\.\d+)?\s*(?:per\s*cent|percent|%))$", 1)
        at = x["e"] - F.length(tail)
        number = F.regexp_extract(tail, r"^(\d{1,2}(?:\.\d+)?)", 1).cast("double")
        return F.when((number > 0) & (number < 100) & ~part(c, F.greatest(at - 40, F.lit(0)), at).rlike(P.NOT_A_LEVEL), number)

    return F.when(~c.rlike(P.LEVEL_SKIP), F.get(F.filter(F.transform(whole, value), lambda v: v.isNotNull()), 0))


def near_identical(hash_a: Column, n_a: Column, hash_b: Column, n_b: Column) -> Column:
    """Equal hashes, or lengths within 2 % of the greater."""
    return (hash_a == hash_b) | (F.abs(n_a - n_b) / F.greatest(n_a, n_b) <= P.LENGTH_TOLERANCE)


def parse_dates(c: Column) -> Column:
    """(start, end, emergency) of a date or range such as 'August 29 – September 1, 2011'; anything else is an error."""
    t = F.trim(c)
    range_, single = r"^([A-Za-z]+)\s+(\d{1,2})\s*[–-]\s*(?:([A-Za-z]+)\s+)?(\d{1,2}),\s*(\d{4})", r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})"
    at = lambda p, i: F.regexp_extract(t, p, i)
    day = lambda y, m, d: F.make_date(y.cast("int"), _month_number(m), d.cast("int"))
    second = F.when(at(range_, 3) != "", at(range_, 3)).otherwise(at(range_, 1))
    ranged = F.struct(day(at(range_, 5), at(range_, 1), at(range_, 2)).alias("start"), day(at(range_, 5), second, at(range_, 4)).alias("end"))
    one = day(at(single, 3), at(single, 1), at(single, 2))
    found = F.when(t.rlike(range_), ranged).when(t.rlike(single), F.struct(one.alias("start"), one.alias("end")))
    found = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("Cannot parse meeting dates: "), c)).cast("struct<start:date,end:date>"))
    return F.struct(found["start"].alias("start"), found["end"].alias("end"), F.contains(F.lower(c), F.lit("emergency")).alias("emergency"))
