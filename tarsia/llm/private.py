"""Personal data: generators of high recall propose spans, boosted trees decide which of them are added.

Patterns fixed by contract give the base spans (e-mail addresses, IP addresses, card numbers, phone numbers), which
always stay. Further generators propose spans that those patterns miss: numbers that stand beside another number, addresses
in brackets or words. Proposals may overlap. Each has a few small features of its format (checksum or range, way of
writing, digits) and its context (the characters around, numbers and words nearby), packed into one integer.

A proposal that is a base span is a positive example; one whose checksum, range or length is wrong, or that is glued to
letters or digits, a negative one. The examples of all documents are counted by kind, features and fold; these
counts (at most 2 ** 16 for a kind and fold) are all the driver sees. Boosted trees are fitted on the one fold; the other gives,
for each kind, the lowest margin at which they are right often enough, without which nothing is added.

Everything on the way is made of built-in functions: patterns, arrays, one pass folds over arrays. No row moves but the
counts of examples.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, renamed, restored, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns. Possessive, and at the first character of a run only: what they match is the same, in linear time.
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    EMAIL: rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The generators. Each match has a bounded number of parts.
OPEN, CLOSE = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
AT = rf"(?:@|{OPEN}(?:@|at|AT){CLOSE}|\x20(?:at|AT)\x20)"
DOT = rf"(?:\.|{OPEN}(?:\.|dot|DOT){CLOSE}|\x20(?:dot|DOT)\x20)"
GENERATORS = (
    (EMAIL, rf"(?<!{LOCAL}){LOCAL}++{AT}{DOMAIN}++(?:{DOT}[A-Za-z0-9]{DOMAIN}*+){{1,8}}"),
    (IP, rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{OPEN}(?:\.|dot|DOT){CLOSE})[0-9]{{1,3}}){{3}}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    (PHONE, r"(?:\+|(?<![0-9])00)\x20?[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])"),
)
# Words before a span that speak for it, or for another thing.
FOR = r"(?i)(?:mail|phone|tel|call|fax|mobil|card|visa|credit|karte|tarjeta|carte|\bip\b|host|addr|server)"
AGAINST = r"(?i)(?:version|isbn|order|token|hash|sha|key|\bid\b|serial|build|release)"
CONTEXT = 24  # characters before a span, back to the last match of the same pattern

# Features from the lowest bit of a code on, with their bits.
FEATURES = {"valid": 1, "style": 2, "before": 2, "after": 2, "number_before": 1, "number_after": 1, "word_for": 1, "word_against": 1, "digits": 3}
CHUNK = 512
ROUNDS, DEPTH, RATE, PRECISION, LEAST = 20, 3, 0.5, 0.99, 10
SPAN = "start:int,kind:int,end:int"
PROPOSED = f"struct<{SPAN},code:int>"
MARKED = f"struct<{SPAN},code:int,example:boolean,clash:boolean>"  # code -1: a base span


# What is computed for each match and span is written as SQL text: it is one expression of a few thousand parts.


def scan(items: str, state: str, step: Callable[[str, str], str], emit: Callable[[str, str], str], kind: str) -> str:
    """Goes through an array from left to right: emit(state, x) of each x, in an array of that kind, where step(state, x)
    is the next state. What an aggregation has gathered is copied at each of its steps, so the array is taken in
    chunks: in them results are gathered one by one, over them chunk by chunk."""
    one = f"(a, x) -> named_struct('state', {step('a.state', 'x')}, 'out', concat(a.out, array(cast({emit('a.state', 'x')} AS {kind}))))"
    part = f"aggregate(slice(every, at + 1, {CHUNK}), named_struct('state', acc.state, 'out', cast(array() AS array<{kind}>)), {one})"
    more = f"(acc, at) -> {let(part, 'p', "named_struct('state', p.state, 'done', concat(acc.done, array(p.out)))")}"
    start = f"named_struct('state', {state}, 'done', cast(array() AS array<array<{kind}>>))"
    return let(items, "every", f"aggregate(sequence(0, greatest(size(every), 1) - 1, {CHUNK}), {start}, {more}, acc -> flatten(acc.done))")


def let(value: str, name: str, then: str) -> str:
    """The expression then, in which a name stands for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def matches(pattern: str) -> str:
    """The matches of a pattern in the column text: start, end (in characters), m (itself), before and after (what stands
    around, up to the neighbouring matches)."""
    kind = "struct<start:int,end:int,m:string,before:string,after:string>"
    pieces = f"arrays_zip(regexp_extract_all(text, r'{pattern}', 0), split(text, r'{pattern}', -1))"  # 0 and 1; the last piece has no match
    nothing = "named_struct('start', 0, 'end', 0, 'm', cast(null AS string), 'before', '')"

    def step(s: str, x: str) -> str:
        start = f"{s}.end + length({x}.`1`)"
        return f"named_struct('start', {start}, 'end', {start} + coalesce(length({x}.`0`), 0), 'm', {x}.`0`, 'before', right({x}.`1`, {CONTEXT}))"

    def emit(s: str, x: str) -> str:  # the match before this piece, now that what follows is known
        return f"named_struct('start', {s}.start, 'end', {s}.end, 'm', {s}.m, 'before', {s}.before, 'after', left({x}.`1`, 4))"

    return f"filter({scan(pieces, nothing, step, emit, kind)}, s -> s.m is not null)"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def octets(m: str, by: str = "[.]") -> str:
    return f"forall(split({m}, '{by}'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(left(ltrim('0', p), 3) AS int), 0) <= 255)"


def fitting(kind: int, m: str) -> str:
    """What a match of a base pattern has to fulfil."""
    d = digits(m)
    return {EMAIL: "true", IP: octets(m), CARD: f"length({d}) between 12 and 19 and luhn_check({d})", PHONE: f"length({d}) between 9 and 15"}[kind]


def base_spans(kind: int) -> str:
    return f"transform(filter({matches(BASE[kind])}, s -> {fitting(kind, 's.m')}), s -> cast(struct(s.start, {kind}, s.end, -1) AS {PROPOSED}))"


def side(c: str) -> str:
    """0 none or a blank, 1 letter, 2 digit, 3 other."""
    return rf"CASE WHEN {c} = '' or {c} rlike r'^\s' THEN 0 WHEN {c} rlike '^[0-9]' THEN 2 WHEN {c} rlike r'^\p{{L}}' THEN 1 ELSE 3 END"


def features(kind: int) -> list[str]:
    """Of a proposal s, in the order of FEATURES. Style: 0 as in the base pattern, 1 brackets, 2 words, 3 mixed or rare."""
    d, bracket = digits("s.m"), r"s.m rlike r'[\[({<]'"
    if kind == EMAIL:
        valid = r"s.m rlike r'[.\x20\])}>][A-Za-z]{2,8}$'"
        at, dot = r"s.m rlike r'(?i)\x20at\x20'", r"s.m rlike r'(?i)\x20dot\x20'"
        style = f"CASE WHEN {at} and {dot} THEN 2 WHEN {at} THEN 3 WHEN {bracket} THEN 1 WHEN {dot} THEN 3 ELSE 0 END"
    elif kind == IP:
        valid, style = octets("s.m", "[^0-9]+"), f"if({bracket}, 1, 0)"
    elif kind == CARD:
        valid, style = f"luhn_check({d})", r"CASE WHEN s.m rlike '[./_]' THEN 3 WHEN s.m rlike r'[\x20-]' THEN 1 ELSE 0 END"
    else:
        valid, style = f"length({d}) between 9 and 15", "CASE WHEN startswith(s.m, '00') THEN 2 WHEN s.m rlike '[()]' THEN 1 ELSE 0 END"
    return [
        f"cast({valid} AS int)", style, side("right(s.before, 1)"), side("left(s.after, 1)"), r"cast(s.before rlike r'[0-9][\x20().-]*$' AS int)", r"cast(s.after rlike r'^[\x20().-]*[0-9]' AS int)",
        f"cast(s.before rlike r'{FOR}' AS int)", f"cast(s.before rlike r'{AGAINST}' AS int)", f"least(greatest(length({d}) - 9, 0), 7)" if kind in (CARD, PHONE) else "0",
    ]


def proposed_spans(kind: int, pattern: str) -> str:
    code, at = [], 0
    for x, bits in zip(features(kind), FEATURES.values()):
        code.append(f"shiftleft({x}, {at})")
        at += bits
    return f"transform({matches(pattern)}, s -> cast(struct(s.start, {kind}, s.end, {' + '.join(code)}) AS {PROPOSED}))"


def compared(*by: str) -> str:
    """A comparator for array_sort."""
    out = "0"
    for c in reversed(by):
        out = f"CASE WHEN a.{c} < b.{c} THEN -1 WHEN a.{c} > b.{c} THEN 1 ELSE {out} END"
    return f"(a, b) -> {out}"


def marked(items: str) -> str:
    """Base spans and proposals in order, the proposals with what base spans tell: example (it is one), clash (it
    overlaps one)."""
    none = "named_struct('start', -1, 'kind', -1, 'end', -1, 'reach', 0)"

    def step(s: str, x: str) -> str:
        return f"if({x}.code < 0, named_struct('start', {x}.start, 'kind', {x}.kind, 'end', {x}.end, 'reach', greatest({s}.reach, {x}.end)), {s})"

    def emit(s: str, x: str) -> str:
        same = f"{s}.start = {x}.start and {s}.kind = {x}.kind and {s}.end = {x}.end"
        return f"struct({x}.start, {x}.kind, {x}.end, {x}.code, {x}.code >= 0 and {same}, {x}.code >= 0 and {s}.reach > {x}.start)"

    def later(s: str, x: str) -> str:  # from the right: where the next base span begins
        return f"if({x}.code < 0, {x}.start, {s})"

    def also(s: str, x: str) -> str:
        return f"struct({x}.start, {x}.kind, {x}.end, {x}.code, {x}.example, {x}.clash or ({x}.code >= 0 and {s} < {x}.end))"

    # A base span stands before proposals of its start and kind: its code is -1.
    order = f"array_sort({items}, {compared('start', 'kind', 'code', 'end')})"
    return f"reverse({scan(f'reverse({scan(order, none, step, emit, MARKED)})', str(2**31 - 1), later, also, MARKED)})"


def proposals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with found (array of marked spans) and fold (0 or 1, by the text) from text."""
    number, at = "text rlike '[0-9]'", r"text rlike r'@|[\[({< ](?:at|AT)[\])}> ]'"
    some = [(kind, base_spans(kind)) for kind in BASE] + [(kind, proposed_spans(kind, p)) for kind, p in GENERATORS]
    arrays = ", ".join(f"if({at if kind == EMAIL else number}, {spans}, cast(array() AS array<{PROPOSED}>))" for kind, spans in some)
    texts = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    found = texts.select(*keep, F.expr("cast(pmod(xxhash64(text), 2) AS int)").alias("fold"), F.expr(f"concat({arrays})").alias("found"))
    return found.withColumn("found", F.expr(marked("found")))


class Model(NamedTuple):
    trees: dict[int, list]  # by kind; a tree is a leaf's number, or (feature, most, left, right)
    least: dict[int, float]  # the margin from which a proposal of the kind is added; no entry: none is


def unpacked(code: np.ndarray) -> np.ndarray:
    out, at = [], 0
    for bits in FEATURES.values():
        out.append(code >> at & (1 << bits) - 1)
        at += bits
    return np.stack(out, axis=1)


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> object:
    """A tree on gradients and curvatures: leaves are whole thousandths, so that any engine adds them up alike."""
    leaf = int(round(1000 * RATE * g.sum() / (h.sum() + 1.0)))
    best, score = None, g.sum() ** 2 / (h.sum() + 1.0) + 1e-6
    for f in range(x.shape[1]) if depth else ():
        for most in np.unique(x[:, f])[:-1]:
            a = x[:, f] <= most
            now = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[~a].sum() ** 2 / (h[~a].sum() + 1.0)
            if now > score:
                best, score = (f, int(most), a), now
    if best is None:
        return leaf
    f, most, a = best
    return f, most, grown(x[a], g[a], h[a], depth - 1), grown(x[~a], g[~a], h[~a], depth - 1)


def value(tree: object, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, most, left, right = tree
    return np.where(x[:, f] <= most, value(left, x), value(right, x))


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list:
    trees, margin = [], np.zeros(len(x))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grown(x, weight * (y - p), weight * p * (1 - p), DEPTH))
        margin += value(trees[-1], x) / 1000
    return trees


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The lowest margin above 0 (a probability of one half) at which, and above, PRECISION of the held-out examples are
    positive, with LEAST of these."""
    out = None
    for t in np.unique(margin[margin > 0])[::-1]:
        there = margin >= t
        right = weight[there & (y == 1)].sum()
        if right < PRECISION * weight[there].sum():
            break
        if right >= LEAST:
            out = float(t)
    return out


def fit(found: DataFrame) -> Model:
    """Learns from the counts of examples in all rows. E-mail and IP addresses also count as positive ones in the other
    styles (in brackets, in words), since the base patterns have one style only."""
    cells = found.select("fold", F.explode("found").alias("s")).filter("s.code >= 0").groupBy("fold", "s.kind", "s.code").agg(F.sum(F.col("s.example").cast("long")).alias("yes"), F.count("*").alias("n")).collect()
    trees, least = {}, {}
    names = list(FEATURES)
    for kind in range(len(KINDS)):
        rows = [(r.fold, r.code, r.yes, r.n) for r in cells if r.kind == kind]
        fold, code, yes, n = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        x = unpacked(code)
        wrong = (x[:, 0] == 0) | np.isin(x[:, 2], (1, 2)) | np.isin(x[:, 3], (1, 2)) | ((x[:, 1] == 3) if kind == EMAIL else False)
        no = np.where(wrong, n - yes, 0)
        examples = [(fold, x, np.ones(len(x)), yes), (fold, x, np.zeros(len(x)), no)]
        for style in (1, 2) if kind == EMAIL else (1,) if kind == IP else ():
            other = x.copy()
            other[:, names.index("style")] = style
            examples.append((fold, other, np.ones(len(x)), yes))
        f, x, y, w = (np.concatenate(c) for c in zip(*examples))
        f, x, y, w = f[w > 0], x[w > 0], y[w > 0], w[w > 0].astype(float)
        if not len(x) or not (f == 0).any():
            continue
        trees[kind] = boosted(x[f == 0], y[f == 0], w[f == 0])
        margin = sum(value(t, x[f == 1]) for t in trees[kind])
        if (t := calibrated(margin, y[f == 1], w[f == 1])) is not None:
            least[kind] = t
    return Model(trees, least)


def margin_of(tree: object, at: list[str]) -> str:
    if not isinstance(tree, tuple):
        return str(int(tree))
    f, most, left, right = tree
    return f"if({at[f]} <= {most}, {margin_of(left, at)}, {margin_of(right, at)})"


def margin(model: Model) -> str:
    """The margin of a proposal s over its kind's threshold, in thousandths; null where the kind has none."""
    at, low = [], 0
    for bits in FEATURES.values():
        at.append(f"(shiftright(s.code, {low}) & {(1 << bits) - 1})")
        low += bits
    kinds = [f"WHEN s.kind = {k} THEN {' + '.join(margin_of(t, at) for t in model.trees[k])} - {int(np.ceil(least))}" for k, least in model.least.items()]
    return f"CASE {' '.join(kinds)} END" if kinds else "cast(null AS int)"


def decided(found: DataFrame, model: Model) -> DataFrame:
    """found becomes spans: array of start, end, kind (its name), base (else added), by start and kind.

    Added are proposals that overlap no base span and whose margin reaches the threshold. Of two that overlap, from left to
    right, the one of the higher margin stays, of equal ones the first."""
    kind, scored = f"struct<{SPAN},base:boolean>", f"struct<{SPAN},margin:int>"
    of_base = f"transform(filter(found, s -> s.code < 0), s -> cast(struct(s.start, s.kind, s.end, true) AS {kind}))"
    good = f"filter(transform(filter(found, s -> s.code >= 0 and not s.clash), s -> cast(struct(s.start, s.kind, s.end, {margin(model)}) AS {scored})), s -> s.margin >= 0)"
    nothing, last = (f"cast(struct({x}, 0, {x}, -1) AS {scored})" for x in (-1, 2**31 - 1))

    def step(s: str, x: str) -> str:
        return f"if({x}.start < {s}.end and {x}.margin <= {s}.margin, {s}, {x})"

    def emit(s: str, x: str) -> str:  # what is settled: the one before, if this one begins behind it
        return f"if({x}.start >= {s}.end, {s}, null)"

    settled = f"filter({scan(f'concat({good}, array({last}))', nothing, step, emit, scored)}, s -> s.start >= 0)"
    added = f"transform({settled}, s -> cast(struct(s.start, s.kind, s.end, false) AS {kind}))"
    names = ", ".join(f"'{k}'" for k in KINDS)
    out = f"transform(array_sort(concat({of_base}, {added}), {compared('start', 'kind', 'end')}), s -> named_struct('start', s.start, 'end', s.end, 'kind', element_at(array({names}), s.kind + 1), 'base', s.base))"
    return found.select(*[c for c in found.columns if c not in ("found", "fold")], F.expr(out).alias("spans"))


def personal_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds spans (array of start, end, kind, base; characters, end exclusive; by start, then kind) to docs, of which text is
    read. Without a model one is fitted on docs first.

    A null text counts as empty: no spans. Each row is taken by itself, so repeated rows get equal spans, and ids may be
    null. A column spans in docs, in any case, is replaced; all other columns stay."""
    frame, own = renamed(docs, ["spans"])
    made = proposals(frame.withColumn("text", F.col(own["text"])), list(own.values()))
    model = model or fit(made)
    return decided(made, model).select(*restored(own), "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """Docs with spans (as of personal_spans): text with each span as its kind in brackets. Of overlapping spans the part
    that lies behind the first is taken into it. A null text stays null."""
    step = lambda s, x: f"named_struct('at', greatest({s}.at, {x}.end), 'text', {s}.text)"
    emit = lambda s, x: f"if({x}.start >= {s}.at, concat(substring({s}.text, {s}.at + 1, {x}.start - {s}.at), '[', upper({x}.kind), ']'), '')"
    parts = scan("spans", "named_struct('at', 0, 'text', text)", step, emit, "string")
    rest = "substring(text, coalesce(array_max(transform(spans, s -> s.end)), 0) + 1, length(text))"
    return docs.withColumn("text", F.expr(f"concat(array_join({parts}, ''), {rest})"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of base spans; spans lists these and the added ones."""
    found = written(proposals(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))
    out = decided(found, fit(found))
    base = "filter(spans, s -> s.base)"
    joined = lambda a: f"array_join(transform({a}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    number = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) AS bigint) AS n_{k}") for k in KINDS]
    return out.select("doc_id", *number, F.expr(f"sha2({joined(base)}, 256) AS base_sha256"), F.expr(f"{joined('spans')} AS spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
SQL: dict[str, str] = {}
