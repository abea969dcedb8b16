"""Secrets in texts: fixed patterns, and strings of high entropy.

Patterns are matched leftmost without overlap, by kind. Beside them, every candidate string (a
long run of one character class) is scanned by a sliding window. The window keeps the count of
every character and the sum of ``c log2 c``; one character in and one out change two terms of
the sum, so its Shannon entropy ``log2 w - sum / w`` costs the same for any window. Strings of hex
digits, of small letters and digits, of capitals and digits, and of base64 characters are classes of
their own, since fewer characters give less entropy; a string may be reported by several. Sample words
hide the path part that holds them. A candidate is reported from the start of its first window to the end of its last window at or above the
threshold of its class, unless it matches the allow-list or lies inside a pattern's span. The
allow-list never hides a pattern's span.

Positions are code points, ends are exclusive. Null and empty texts have no spans, repeated rows
are scanned each, an empty table gives no rows, other columns are not read. Everything is a
DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The kinds in their order, their patterns, the group that is measured and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A pattern that finds the same spans as the kind after its length test, where there is one: it skips short runs at once.
DIRECT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


@dataclass(frozen=True)
class CharacterClass:
    """Runs of at least ``window`` characters of ``alphabet``, and the entropy that marks a secret."""

    name: str
    pattern: str
    alphabet: str
    window: int
    threshold: float


_PART = "[0-9A-Za-z+_-]"  # a path part of base64 characters
_SAMPLE = "(?i:example|0123456789|abcdefghij)"  # samples and alphabets
_HEX, _LOWER, _UPPER = "0123456789ABCDEFabcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(run: str, letters: str) -> str:
    """Whole runs of 20 and more that hold ``letters``; none beside a sample word of the same path part, up to 256 characters on."""
    return f"(?<!{run})(?<!(?i:example)[-_+])(?={run}{{20}})(?={letters})(?!{_PART}{{0,256}}{_SAMPLE}){run}{{20,}}"


# Thresholds: of random strings with these characters, one in a thousand has a lower entropy in its only window.
CLASSES = (
    CharacterClass("hex_entropy", _plain("[0-9A-Fa-f]", ""), _HEX, 20, 2.7),
    CharacterClass(
        # Neighbouring path parts without a sample word, in runs of 20 and more.
        "base64_entropy",
        f"(?<!{_PART})(?=[0-9A-Za-z+/_-]{{20}})(?!{_PART}*{_SAMPLE})(?={_PART}|/(?!{_PART}*{_SAMPLE}))"
        f"{_PART}*+(?:/(?!{_PART}*{_SAMPLE}){_PART}*+)*+",
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", 20, 3.45,
    ),
    CharacterClass("lower_entropy", _plain("[0-9a-z]", "[a-z]*[0-9]"), _LOWER, 20, 3.2),
    CharacterClass("upper_entropy", _plain("[0-9A-Z]", "[A-Z]*[0-9]"), _UPPER, 20, 3.1),  # as of base32
)
_WORD = "(?:[a-z]+(?:[A-Z][a-z]{2,})*+|[A-Z][a-z]*(?:[A-Z][a-z]{2,})*+|[A-Z]{2,15}|[0-9]+)(?![0-9A-Za-z])"
ALLOW = (
    "[0-9]+", "[0-9]{1,4}+(?:[-_/][0-9]{1,4}+)++",  # numbers and dates
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    f"[-_/]*+(?:{_WORD}(?:[-_/]++{_WORD})*+[-_/]*+)?",  # words and numbers, and paths of them
)


CHUNK = 256  # elements that one running pass appends to an array


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or its lambdas name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(
    items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], empty: Column,
) -> Column:
    """``emit(before, item)`` of every item, where ``before`` combines the whole numbers of all items before it (0 at first).

    Appending to an array copies it, so items go in chunks: each starts at the combination of the
    chunks before, and what they emit is joined at once.
    """
    zero = F.lit(0)
    chunk = lambda xs, c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK))

    def inside(xs: Column, c: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), empty.alias("out"))
        step = lambda acc, x: F.struct(
            combine(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out")
        )
        return F.aggregate(chunk(xs, c), begin, step, lambda acc: acc["out"])

    def whole(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / CHUNK).cast("int") - 1, zero))
        totals = F.transform(chunks, lambda c: F.aggregate(chunk(xs, c), zero, lambda acc, x: combine(acc, value(x))))
        starts = F.aggregate(totals, F.array(zero), lambda acc, t: F.concat(acc, F.array(combine(F.element_at(acc, -1), t))))
        return _bound(starts, lambda known: F.flatten(F.transform(chunks, lambda c: inside(xs, c, F.get(known, c)))))

    return _bound(items, whole)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of every leftmost match; the pieces between give the positions."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("match"))

    found = _running(pieces, width, lambda a, b: a + b, span, empty)
    return F.when(text.rlike(pattern), F.filter(found, lambda m: m["match"].isNotNull())).otherwise(empty)


def _fixed(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of a kind whose group is long enough."""
    if kind in DIRECT:
        return matches(text, DIRECT[kind])
    return F.filter(
        matches(text, pattern), lambda m: F.length(F.regexp_extract(m["match"], pattern, group)) >= least
    )


def _log_term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def hot_windows(string: Column, kind: CharacterClass) -> Column:
    """(first, last): starts of the first and the last window at or above the threshold, or -1.

    The counts are one string with a character a count, so that a step replaces one character.
    """
    w = kind.window
    # After the first window, odd steps take a character out and even steps take one in.
    late = lambda k: k > w
    out = lambda k: late(k) & ((k - w) % 2 == 1)
    place = lambda k: (
        F.when(~late(k), k).when(out(k), ((k - w + 1) / 2).cast("int")).otherwise(((k - w) / 2).cast("int") + w)
    )
    begin = F.struct(
        F.lit("0" * len(kind.alphabet)).alias("counts"), F.lit(0.0).alias("total"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def scanned(letters: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            code = F.instr(F.lit(kind.alphabet), F.element_at(letters, place(k)))
            count = F.ascii(acc["counts"].substr(code, F.lit(1))) - 48
            after = count + F.when(out(k), -1).otherwise(1)
            total = acc["total"] + _log_term(after) - _log_term(count)
            entropy = F.lit(w).cast("double")
            entropy = F.log2(entropy) - total / entropy
            hot = ~out(k) & (k >= w) & (entropy >= kind.threshold - 1e-9)
            window = place(k) - w
            return F.struct(
                F.overlay(acc["counts"], F.char(after + 48), code, 1).alias("counts"), total.alias("total"),
                F.when(hot & (acc["first"] < 0), window).otherwise(acc["first"]).alias("first"),
                F.when(hot, window).otherwise(acc["last"]).alias("last"),
            )

        steps = F.sequence(F.lit(1), F.length(string) + F.greatest(F.length(string) - w, F.lit(0)))
        return F.aggregate(steps, begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _bound(F.split(string, ""), scanned)


def _entropy_spans(text: Column, kind: CharacterClass, allow: Sequence[str]) -> Column:
    """Spans of a class; candidates on the allow-list are not scanned."""
    allowed = "^(?:" + "|".join(f"(?:{a})" for a in allow) + ")$" if allow else "(?!)"
    candidates = F.filter(matches(text, kind.pattern), lambda m: ~m["match"].rlike(allowed))
    scanned = F.transform(
        candidates, lambda m: F.struct(m["start"].alias("start"), hot_windows(m["match"], kind).alias("hot"))
    )
    return F.transform(
        F.filter(scanned, lambda s: s["hot"]["first"] >= 0),
        lambda s: F.struct(
            (s["start"] + s["hot"]["first"]).alias("start"), (s["start"] + s["hot"]["last"] + kind.window).alias("end")
        ),
    )


def _named(spans: Column, rank: int, name: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")),
    )


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(
    docs: DataFrame, keep: Sequence[str] = (), text: str = "text",
    classes: Sequence[CharacterClass] = CLASSES, allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """The ``keep`` columns with ``base`` and ``spans``: arrays of (start, rank, end, kind) by start."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    body = F.col("_text")
    fixed = [_named(_fixed(body, *k), rank, k[0]) for rank, k in enumerate(KINDS)]
    extra = [_named(_entropy_spans(body, k, allow), len(KINDS) + rank, k.name) for rank, k in enumerate(classes)]
    rows = rows.select(*keep, F.array_sort(F.concat(*fixed)).alias("base"), *[e.alias(f"_{i}") for i, e in enumerate(extra)])
    return rows.select(*keep, "base", _uncovered(F.array_sort(F.concat("base", *[F.col(f"_{i}") for i in range(len(extra))]))).alias("spans"))


def _uncovered(spans: Column) -> Column:
    """Spans by start and rank without those of a class inside a pattern's: the furthest end of the patterns up to a start tells."""
    fixed = lambda s: s["rank"] < len(KINDS)
    marked = "struct<start:int,rank:int,end:int,kind:string,inside:boolean>"
    seen = _running(
        spans, lambda s: F.when(fixed(s), s["end"]).otherwise(0), F.greatest,
        lambda at, s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), (~fixed(s) & (at >= s["end"])).alias("inside"),
        ),
        F.array().cast(f"array<{marked}>"),
    )
    left = F.filter(seen, lambda s: ~s["inside"])
    return F.transform(left, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")]))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
