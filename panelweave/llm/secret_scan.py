"""Secret scans: patterns and sliding-window entropy over candidate strings. DataFrame functions only.

Spark has no function for the places of all matches. split() and
regexp_extract_all() walk the same matches, so the pieces between matches and
the matches themselves alternate, and running sums of their lengths in code
points are the places.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import free_name

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same maximal runs, without a match for every short one.
LONG_HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Fixed values. Least entropy in bits of a window of 20 characters, by the narrowest class that holds the candidate.
WINDOW = 20
LEAST = {"hex": 2.9, "letters": 4.05, "alnum": 3.75, "base64": 3.9}


#: Letters in an order that is well known not to be secret, from any of them on and begun again at the end: the alphabet, rows of keys.
ORDERS = ("abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "qwertyuiopasdfghjklzxcvbnm")
#: A word of camel case: a capital, two small letters or more, a vowel among them.
HUMP = "(?=[AEIOUY]|[A-Z][a-z]*[aeiouy])[A-Z][a-z]{2,}"
#: Other candidates that are well known not to be secrets: UUIDs, numbers, camel case, words with dashes, signs. Repeated groups
#: are possessive, since Java's others recurse once a repetition; letters that other candidates are made of are judged by entropy.
ALLOWED = (
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "[0-9]+",
    f"(?:(?=[a-z]*[aeiouy])[a-z]{{2,}}+|{HUMP})(?:{HUMP})++",
    "[a-z]++(?:[-_/][a-z]++)++",
    "[-=_+/]+",
)


#: Entries of one chunk of an array: sums and searches go through chunks first, so that no text costs the square of its matches.
CHUNK = 64
SPANS = "array<struct<start:int,end:int,kind:string>>"


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once: a one-element array names it."""
    return F.transform(F.array(value), of)[0]


def _chunks(items: Column) -> Column:
    """An array cut into arrays of CHUNK entries; an empty one is one chunk."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK)), lambda at: F.slice(items, at, F.lit(CHUNK)))


def _before(totals: Column, i: Column) -> Column:
    return F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), lambda acc, t: acc + t)


def _walk(steps: Column, kind: str) -> Column:
    """(start, end, kind) of matches from (gap before, size) of each, as running sums over chunks and within."""

    def within(chunk: Column, begin: Column) -> Column:
        def span(s: Column, i: Column) -> Column:
            return _let(begin + _before(F.transform(chunk, lambda x: x["gap"] + x["size"]), i) + s["gap"], lambda at: F.struct(at.alias("start"), (at + s["size"]).alias("end"), F.lit(kind).alias("kind")))

        return F.transform(chunk, span)

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, s: acc + s["gap"] + s["size"]))
        return _let(totals, lambda t: F.flatten(F.transform(chunks, lambda chunk, i: _let(_before(t, i), lambda begin: within(chunk, begin)))))

    return _let(_chunks(steps), over)


def _matches(text: Column, pattern: str, kind: str) -> tuple[Column, Column]:
    """(spans, strings) of all matches in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the lengths of piece 0, match 0, piece 1, match 1, ...
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size")))
    return _walk(steps, kind), found


def _places(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """Spans of all matches whose match or group has ``least`` characters or more."""
    walked, found = _matches(text, pattern, kind)
    if least:
        sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        walked = F.array_compact(F.zip_with(walked, sized, lambda span, x: F.when(F.length(x) >= least, span)))
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPANS))


def _covered(span: Column, chunks: Column) -> Column:
    """Whether a span lies within one of a kind's spans, which are in order and apart; first starts of chunks lead to the one to search."""
    at = F.size(F.filter(chunks, lambda c: F.coalesce(F.get(c, F.lit(0))["start"] <= span["start"], F.lit(False))))
    return F.coalesce(F.exists(F.get(chunks, at - 1), lambda b: (b["start"] <= span["start"]) & (span["end"] <= b["end"])), F.lit(False))


def _class(candidate: Column) -> Column:
    return (
        F.when(candidate.rlike("^[0-9a-f]+$") | candidate.rlike("^[0-9A-F]+$"), "hex")
        .when(candidate.rlike("^[A-Za-z]+$"), "letters")
        .when(candidate.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def _allowed(candidate: Column) -> Column:
    """Whether a candidate is on the allow-list. Time is in proportion to its length."""
    plain = F.lower(candidate)

    def ordered(order: str) -> Column:
        # the candidate is what stands at its first letter in the order, repeated often enough
        rounds = F.repeat(F.lit(order), F.floor(F.length(candidate) / len(order)).cast("int") + 2)
        return plain == F.substr(rounds, F.instr(F.lit(order), F.substring(plain, 1, 1)), F.length(candidate))

    listed = candidate.rlike("^(?:" + "|".join(ALLOWED) + ")$") | (candidate.rlike("^[A-Za-z0-9]+$") & candidate.contains("EXAMPLE"))
    return listed | (candidate.rlike("^[A-Za-z]+$") & reduce(or_, map(ordered, ORDERS)))


def _log(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(0.0)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters of an ASCII string.

    One character comes in and one goes out at a step; only their two counts
    and the sum of count * log2(count) change.
    """
    # named once: an expression of the candidate would be computed again for every character
    return _let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c)), lambda codes: _highest(codes, window))


def _highest(codes: Column, window: int) -> Column:
    at = lambda counts, code: F.element_at(counts, code + 1)

    def put(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code), F.array(at(counts, code) + by), F.slice(counts, code + 2, 127 - code))

    steps = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).alias("old"), i.alias("i")))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def leave(acc: Column, s: Column) -> Column:
        gone = at(acc["counts"], s["old"])
        return F.when(s["old"].isNull(), F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"))).otherwise(
            F.struct(put(acc["counts"], s["old"], -1).alias("counts"), (acc["total"] + _log(gone - 1) - _log(gone)).alias("total"))
        )

    def enter(acc: Column, s: Column) -> Column:
        # a one-element array names the intermediate state, so that it is computed once
        return F.transform(F.array(leave(acc, s)), lambda t: _entered(t, acc["best"], s))[0]

    def _entered(t: Column, best: Column, s: Column) -> Column:
        had = at(t["counts"], s["new"])
        total = t["total"] + _log(had + 1) - _log(had)
        bits = F.log2(F.lit(float(window))) - total / window
        return F.struct(put(t["counts"], s["new"], 1).alias("counts"), total.alias("total"), F.when(s["i"] >= window - 1, F.greatest(best, bits)).otherwise(best).alias("best"))

    return F.aggregate(steps, start, enter, lambda acc: acc["best"])


def _join(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secret_base and secret_spans, arrays of (start, end, kind) in code points, end exclusive.

    Base kinds: assign (a secret's name, a sign, a value of 6+ characters),
    access (AKIA keys of 20+ characters), hex (24+ digits). entropy: other
    candidate strings of 20+ characters of the base64 alphabet of which some
    window of 20 is as random as its character class allows, unless the
    allow-list has them or a base span covers them. Of candidates of letters only,
    the allow-list has runs through the alphabet or the keyboard and words in
    camel case. A null or empty text has no
    spans; a candidate is whole, however long. Other columns pass through; where
    docs has a column of either name, the new one gets underscores (span_names());
    repeated rows are scanned alike; an empty table gives no rows.
    """
    base, spans = span_names(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.array(_places(text, ASSIGN, "assign", 2, 6), _places(text, ACCESS, "access", None, 20), _places(text, LONG_HEX, "hex"))
    walked, strings = _matches(text, CANDIDATE, "entropy")
    spot = F.zip_with(walked, strings, lambda span, x: F.struct(span.alias("span"), x.alias("string")))
    least = F.create_map(*(F.lit(x) for pair in LEAST.items() for x in pair))
    random = lambda r: ~_allowed(r["string"]) & (window_entropy(r["string"]) >= F.element_at(least, _class(r["string"])))
    free = lambda chunked: F.filter(spot, lambda r: ~F.exists(chunked, lambda chunks: _covered(r["span"], chunks)))
    rows = docs.withColumn(base, kinds)
    found = F.transform(F.filter(_let(F.transform(base, _chunks), free), random), lambda r: r["span"])
    found = F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(SPANS))
    return rows.withColumns({spans: F.concat(F.flatten(base), found), base: F.flatten(base)})


def span_names(docs: DataFrame) -> tuple[str, str]:
    """What scan_secrets() calls its two columns beside those of docs."""
    return free_name("secret_base", docs.columns), free_name("secret_spans", docs.columns)


def span_digest(scanned: DataFrame, base: str = "secret_base", spans: str = "secret_spans") -> DataFrame:
    """scan_secrets() rows with n_assign, n_access, n_hex, base_sha256 and spans, in place of columns of these names."""
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    made = {f"n_{k}": count(k) for k in KINDS[:3]} | {"base_sha256": F.sha2(_join(F.col(base)).cast("binary"), 256), "spans": _join(F.col(spans))}
    return scanned.withColumns(made)


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", base: str = "secret_base", spans: str = "secret_spans") -> DataFrame:
    """scan_secrets() rows with every span of the text replaced by mark, overlapping spans as one, without the columns base and spans."""
    text = F.col(text_col)
    reach = lambda chunk: F.array_max(F.transform(chunk, lambda s: s["end"]))

    def pieces(chunk: Column, at: Column) -> Column:
        """The text between the spans of a chunk, each with a mark; at is where the spans before it end."""

        def piece(s: Column, i: Column, segment: Column) -> Column:
            done = F.greatest(at, F.coalesce(reach(F.slice(chunk, F.lit(1), i)), at))
            return F.when(s["start"] < done, "").otherwise(F.concat(F.substring(segment, done - at + 1, s["start"] - done), F.lit(mark)))

        return _let(F.substring(text, at + 1, reach(chunk) - at), lambda segment: F.transform(chunk, lambda s, i: piece(s, i, segment)))

    def whole(chunks: Column) -> Column:
        def written(ends: Column) -> Column:
            parts = F.transform(chunks, lambda chunk, i: _let(F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0)), lambda at: pieces(chunk, at)))
            return F.concat(F.array_join(F.flatten(parts), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

        return _let(F.transform(chunks, reach), written)

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, _let(_chunks(order), whole)).otherwise(text)).drop(base, spans)
