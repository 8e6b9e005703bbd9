"""Text functions as column expressions: normalisation, sentences, words, offsets, similarity.

All offsets count code points. Word boundaries are written out as groups of
ASCII word characters, so that they mean the same in every engine.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Before and after a word: an end of the text or a character that is no ASCII word character.
B, E = r"(?:^|[^A-Za-z0-9_])", r"(?:$|[^A-Za-z0-9_])"
#: Marks a cut, and hides that mark where a text has it.
CUT, HIDE = "␞", "␛"
#: Elements of an array that are summed one after the other.
PART = 64
#: Characters of the slices that parts of a long text are cut from.
SLICE = 256


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def each(rows: DataFrame, array, *keep, name: str = "x", place: str | None = None) -> DataFrame:
    """A row for each element of an array, with the columns ``keep``; ``place`` names its position, if wanted.

    The planner tests an array for emptiness before it explodes it, and makes it
    twice for that; exploded as outer, and its nulls dropped, it is made once.
    """
    made = F.explode_outer(array).alias(name) if place is None else F.posexplode_outer(array).alias(place, name)
    return rows.select(*keep, made).filter(F.col(name).isNotNull())


def let(value, use) -> Column:
    """``use(value)``, with the value made once however often it is used; expressions within lambdas are not shared by the engine."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_like(pattern: str) -> str:
    """A case-blind pattern for whole words."""
    return f"(?i){B}(?:{pattern}){E}"


def words_at(pattern: str) -> str:
    """``words_like`` as Spark's engine finds it soonest: its own class of ASCII word characters, and case ignored in the words alone."""
    return rf"(?:^|\W)(?i:{pattern})(?!\w)"


def _branches(pattern: str) -> list[str]:
    """What stands between the bars of a pattern that are in no group."""
    out, depth, was = [""], 0, ""
    for c in pattern:
        depth += (c == "(") - (c == ")") if was != "\\" else 0
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
        was = "" if was == "\\" else c
    return out


def _by_letter(branch: str) -> list[tuple[str, str]]:
    """(first letter, pattern) of a branch, one for each branch of the group it begins with; a group that may be absent is left out too."""
    if not branch.startswith("(?:"):
        if not branch[:1].isalpha() or branch[1:2] in set("?*{"):
            raise ValueError(f"no letter begins {branch}")
        return [(branch[0].lower(), branch)]
    end = next(k for k in range(len(branch)) if branch[k] == ")" and branch[: k + 1].count("(") == branch[: k + 1].count(")"))
    inner, rest = branch[3:end], branch[end + 1 :]
    inside = [(x, f"(?:{p}){rest.removeprefix('?')}") for b in _branches(inner) for x, p in _by_letter(b)]
    return inside + (_by_letter(rest[1:]) if rest.startswith("?") else [])


def cue(*patterns: str) -> str:
    """A pattern that is found wherever any of ``patterns`` is by ``words_at``: their beginnings at a word's, case ignored.

    Patterns are of words, and begin with a letter or a group of such. They are
    grouped by that letter, so that at most words only letters are looked at.
    """
    groups: dict[str, list[str]] = {}
    for branch in _branches("|".join(patterns)):
        for letter, pattern in _by_letter(branch):
            groups.setdefault(letter, []).append(pattern)
    return r"(?:^|\W)(?:" + "|".join(f"(?=[{x}{x.upper()}])(?i:{'|'.join(groups[x])})" for x in sorted(groups)) + ")"


def normalize_layout(text) -> Column:
    """Joins words hyphenated at a line break, turns line breaks to spaces, collapses blanks, trims."""
    t = col(text)
    t = F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")).otherwise(t)
    # line breaks and blanks in one search; a single blank stays as it is, so it is no match
    t = F.regexp_replace(t, "[\t\n\u00a0][ \t\n\u00a0]*| [ \t\n\u00a0]+", " ")
    return F.btrim(t, F.lit(" \t\n\x0b\f\r\u00a0"))


def normalize_match(text) -> Column:
    """Lower case, plain quotes, dashes and ligatures, other characters to spaces, blanks collapsed."""
    t = F.lower(col(text))
    for a, b in (*zip("‘’“”", "''''", strict=True), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        t = F.replace(t, F.lit(a), F.lit(b))
    # what is no letter, digit or quote is or becomes a blank, dashes too
    return F.trim(F.regexp_replace(t, "[^A-Za-z0-9' ][^A-Za-z0-9']*| [^A-Za-z0-9']+", " "))


_PLAIN = str.maketrans({"‘": "'", "’": "'", "“": "'", "”": "'", "–": "-", "—": "-", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"})


def _spelt(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        for a, b in _PLAIN.items():
            t = t.replace(chr(a), b)
    return t


def normal(text: str) -> str:
    """As ``normalize_match``, of a Python string."""
    return " ".join(re.sub("[^a-z0-9']", " ", _spelt(text)).split())


def plain(text: str) -> str | None:
    """A text with each character as ``normal`` has it, blanks not collapsed; None where a character becomes several."""
    t = _spelt(text)
    return re.sub("[^a-z0-9']", " ", t) if len(t) == len(text) else None


#: Characters that normalisation keeps, among them those that stand for two.
KEPT, LIGATURES = "A-Za-z0-9'‘’“”ﬁﬂﬀ", {"ffi": "(?:ffi|ﬀi|fﬁ)", "ffl": "(?:ffl|ﬀl|fﬂ)", "ff": "(?:ff|ﬀ)", "fi": "(?:fi|ﬁ)", "fl": "(?:fl|ﬂ)"}


def match_index(text) -> Column:
    """What places in a normalised text are looked up with: struct of the text as it is (t), normalised (n), and the places of its words (w), runs of characters that normalisation keeps."""
    words = transform_hits(text, f"[{KEPT}]+")
    return F.struct(col(text).alias("t"), normalize_match(text).alias("n"), words.alias("w"))


def transform_hits(text, pattern: str) -> Column:
    return F.transform(hits(text, pattern), lambda h: F.struct(h["start"].alias("s"), (h["start"] + F.length(h["text"])).alias("e")))


def raw_place(index, passage) -> Column:
    """(s, e): where a passage stands in a text, given its ``match_index``, if both are normalised; null if it doesn't.

    Words stand in the normalised text in the order of the raw one, one blank between
    them; so the blanks before a place count the words before it, and what follows
    the last blank is its place within the word. A ligature is one raw character.
    The text is searched once and its blanks are counted once; those of the passage
    lead on from its beginning to its end.
    """

    def raw(i, word, within):
        def at(w):
            spelt = F.substring(i["t"], w["s"] + 1, w["e"] - w["s"])
            long = lambda x, r: F.length(normalize_ligatures(F.substring(x, F.lit(1), r)))
            moved = lambda x: F.get(F.filter(F.sequence(F.lit(1), F.length(x)), lambda r: long(x, r) > within), F.lit(0)) - 1
            return w["s"] + let(spelt, lambda x: F.when(x.rlike("[ﬁﬂﬀ]"), moved(x)).otherwise(within))

        return let(F.get(i["w"], word), at)

    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    last = lambda x: F.length(F.substring_index(x, " ", -1))

    def found(x):
        i, n = x["i"], x["n"]

        def ends(b):
            inner = F.substring(n, F.lit(1), F.length(n) - 1)
            begin = F.struct(blanks(b).alias("word"), last(b).alias("within"))
            end = lambda y: F.struct(blanks(y).alias("more"), last(y).alias("within"))
            places = let(F.struct(begin.alias("b"), let(inner, end).alias("e")), lambda p: F.struct(raw(i, p["b"]["word"], p["b"]["within"]).alias("s"), (raw(i, p["b"]["word"] + p["e"]["more"], F.when(p["e"]["more"] > 0, p["e"]["within"]).otherwise(p["b"]["within"] + p["e"]["within"])) + 1).alias("e")))
            return places

        before = lambda at: F.when((n != "") & (at > 0), let(F.substring(i["n"], F.lit(1), at - 1), ends))
        return let(F.instr(i["n"], n), before)

    return let(F.struct(col(index).alias("i"), normalize_match(passage).alias("n")), found)


def normalize_ligatures(text) -> Column:
    t = col(text)
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def cut(text, *places: tuple) -> Column:
    """The text cut where patterns match, one after the other; joined the pieces give the text.

    A place is a pattern, its parts before and after the cut, and strings, if any, one
    of which is in a text wherever the pattern is. Where the mark of a
    cut, or the mark that hides it, occurs in the text itself, both are written with
    letters while the text is cut.
    """
    t = col(text)

    def pieces(x):
        for pattern, before, after, *held in places:
            made = F.regexp_replace(x, pattern, f"{before}{CUT}{after}")
            x = F.when(reduce(or_, [F.contains(t, F.lit(h)) for h in held]), made).otherwise(x) if held else made
        return F.split(x, CUT)

    hidden = F.replace(F.replace(t, F.lit(HIDE), F.lit(f"{HIDE}h")), F.lit(CUT), F.lit(f"{HIDE}c"))
    shown = lambda x: F.replace(F.replace(x, F.lit(f"{HIDE}c"), F.lit(CUT)), F.lit(f"{HIDE}h"), F.lit(HIDE))
    return F.when(F.contains(t, F.lit(CUT)) | F.contains(t, F.lit(HIDE)), F.transform(pieces(hidden), shown)).otherwise(pieces(t))


def sentence_pieces(text) -> Column:
    """The sentences of a text, each with the white space that follows it: joined they give the text."""
    return cut(text, (r"([.!?])(\s+)([A-Z\[(\"'])", "$1$2", "$3"), (r"([.!?]\")(\s+)", "$1$2", "", '."', '!"', '?"'))


def sentences(text) -> Column:
    return F.transform(sentence_pieces(text), lambda x: F.rtrim(x))


def running(lengths) -> Column:
    """The sum of the elements before each of an array of integers.

    An array that is appended to is copied each time, so sums are made by parts of
    ``PART`` elements, and each part from the sum of those before it.
    """
    empty = F.array().cast("array<int>")

    def sums(array, first):
        start = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(array, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]

    def by_parts(all_):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), lambda k: F.slice(all_, k * PART + 1, PART))
        total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
        return F.when(F.size(all_) <= PART, sums(all_, F.lit(0))).otherwise(let(parts, lambda p: F.flatten(F.zip_with(p, sums(F.transform(p, total), F.lit(0)), sums))))

    return let(lengths, by_parts)


def starts(pieces) -> Column:
    """The offset at which each piece of an array begins in their concatenation."""
    return running(F.transform(pieces, lambda x: F.length(x)))


def hits(text, pattern: str) -> Column:
    """Matches of a pattern, as array of (start, text).

    The text is split at the matches; lengths of what lies between and of the
    matches themselves add up to the offsets.
    """
    t = col(text)
    # a text without matches is searched once
    both = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda f: F.struct(f.alias("found"), F.when(F.size(f) > 0, F.split(t, pattern, -1)).alias("between")))

    def located(x):
        parts = F.flatten(F.zip_with(x["between"], x["found"], lambda a, b: F.array(F.length(a), F.coalesce(F.length(b), F.lit(0)))))
        at = F.filter(running(parts), lambda s, i: i % 2 == 1)
        return let(at, lambda y: F.transform(x["found"], lambda h, i: F.struct(F.get(y, i).alias("start"), h.alias("text"))))

    none = lambda x: F.transform(x["found"], lambda h: F.struct(F.lit(None).cast("int").alias("start"), h.alias("text")))
    return let(both, lambda x: F.when(F.size(x["found"]) > 0, located(x)).otherwise(none(x)))


def slices(text) -> Column:
    """A text in slices of ``SLICE`` characters. To find a place in a long text its characters are counted, so what is cut from it often is cut from these."""
    return F.regexp_extract_all(col(text), F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))


def between(parts, low, high) -> Column:
    """The characters ``low`` to ``high`` (not included) of a text, given its ``slices``."""
    first = F.floor(low / SLICE).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.greatest(F.ceil(high / SLICE).cast("int") - first, F.lit(0))), "")
    return F.substring(near, low - first * SLICE + 1, high - low)


def rank(ordered, x) -> Column:
    """How many elements of a sorted array are ``x`` or less, found by halving."""

    def step(s, _):
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        halved = F.when(F.get(ordered, middle) <= x, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))
        return F.when(s["lo"] < s["hi"], halved).otherwise(s)

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(ordered).cast("long"))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), step)["lo"]


def count(text, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)))


def word_count(text) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda x: x != ""))


def half_up(x, digits: int = 0) -> Column:
    """Rounds halves toward positive infinity."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def bigrams(text) -> Column:
    n = F.length(col(text))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(col(text), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def numbered_bigrams(text) -> Column:
    """The pairs of characters of a text, equal ones numbered, so that multisets are sets; in sorted order a pair's number is how far it stands from the first of its kind."""
    numbered = lambda pairs: F.transform(pairs, lambda g, i: F.concat(g, (i + 1 - F.array_position(pairs, g)).cast("string")))
    return let(F.sort_array(bigrams(text)), numbered)


def dice(a, b) -> Column:
    """Dice coefficient of the multisets of character pairs; for short strings. Each text's pairs are made once."""
    both = F.struct(numbered_bigrams(a).alias("x"), numbered_bigrams(b).alias("y"))
    share = let(both, lambda p: 2.0 * F.size(F.array_intersect(p["x"], p["y"])) / F.nullif(F.size(p["x"]) + F.size(p["y"]), F.lit(0)))
    return F.when(col(a) == col(b), 1.0).when((F.length(col(a)) < 2) | (F.length(col(b)) < 2), 0.0).otherwise(share)


def levenshtein_ratio(a, b) -> Column:
    """One less the edit distance over the longer length; the Dice coefficient where that is over 400."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longer == 0, 1.0).when(longer > 400, dice(a, b)).otherwise(1.0 - F.levenshtein(col(a), col(b)) / longer)


def similarity(a, b, least: float = 0.0) -> Column:
    """Of two normalised strings: containment 0.85 to 1, else the better of Dice and, for short strings, the edit ratio.

    What their lengths keep from reaching ``least`` may come out as 0, without being compared.
    """
    la, lb = F.length(col(a)), F.length(col(b))
    inside = F.contains(col(a), col(b)) | F.contains(col(b), col(a))
    short = F.greatest(la, lb) < 120
    # of n characters and m more, n - 1 pairs are shared at most, and m edits are needed at least
    shorter, longer = F.least(la, lb), F.greatest(la, lb)
    most = F.greatest(2.0 * (shorter - 1) / F.nullif(la + lb - 2, F.lit(0)), F.when(longer < 120, shorter / longer))
    return (
        F.when((la == 0) | (lb == 0), 0.0)
        .when(col(a) == col(b), 1.0)
        .when(inside, 0.85 + 0.15 * (F.least(la, lb) / F.greatest(la, lb)))
        .when(most < least - 1e-6, 0.0)
        .when(short, F.greatest(dice(a, b), levenshtein_ratio(a, b)))
        .otherwise(dice(a, b))
    )


def ascii_latin(text) -> Column:
    """Text in Latin-1 only: plain quotes, dashes, dots and blanks; other characters become question marks."""
    t = F.translate(col(text), "‘’“”–—• ", "''\"\"--* ")
    return F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"[^\x09\x0A\x0D\x20-\x7E -ÿ]", "?")


def slug(text, most: int = 60) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(t == "", "untitled").otherwise(F.substring(t, 1, most))


def clip(text, most: int) -> Column:
    """At most so many characters, the last an ellipsis if any was cut."""
    return F.when(F.length(col(text)) <= most, col(text)).otherwise(F.concat(F.substring(col(text), 1, most - 1), F.lit("…")))


def clean_url(url) -> Column:
    """Without trailing punctuation, with a scheme."""
    t = F.regexp_replace(col(url), r"[.,;:)\]]+$", "")
    return F.when(t.rlike(r"^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def number(text) -> Column:
    """A number with thousands commas; null if it is none."""
    return F.replace(col(text), F.lit(","), F.lit("")).try_cast("double")
