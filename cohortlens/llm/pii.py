"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

DataFrame operations only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.stage import staged

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no text takes Java's matcher more than linear time or
# a deep stack: a run of one class is taken whole (nothing after it could match a part of
# it), and a match starts where such a run starts or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser forms, for the labelers to vote on.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[a-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-][0-9]|[0-9])",
}
#: What a text must hold for a pattern to be tried.
GATES = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9][.][0-9]++[.][0-9]++[.][0-9]'",
    "card": r"text rlike '[0-9](?:[ -]?[0-9]){12}'",
    "phone": "contains(text, '+')",
    "loose email": r"text rlike '(?i)[\\[(]at[\\])]'",
    "loose ip": r"text rlike '(?:[0-9A-Fa-f]{1,4}:){7}'",
    "loose phone": r"text rlike '[0-9]{3}[)]? ?[ .-]?[0-9]{3}[ .-][0-9]{4}'",
}
# Fixed values of the gazetteers and of the words that stand before personal data.
GAZETTEER = {
    "email": r"(?i)(?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|172|192|2001|fe80|fc00)[.:]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|44|49)|[(]?(?:2|3|4|5|6|7|8|9)[0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write|address)",
    "ip": r"(?i)(?:\bip\b|host|server|addr|client|login)",
    "card": r"(?i)(?:card|karte|tarjeta|carte|visa|master|amex|credit|pay)",
    "phone": r"(?i)(?:phone|tel|fon|call|mobil|fax|llam|appel)",
}
#: Characters before a match that the context labeler reads.
BEFORE = 40
LABELERS = ("form", "gazetteer", "context")
ROUNDS = 8
ACCEPT = 0.9
CHUNK = 256

SPAN = "struct<start: bigint, end: bigint, m: string, before: string>"


def _matches(kind: str, pattern: str, gate: str, prefix: str) -> list[Column]:
    """What stands between the matches, and the matches, if the gate is open."""
    open_gate = F.expr(gate)
    return [
        F.when(open_gate, F.split("text", pattern, -1)).alias(f"{prefix}{kind}_p"),
        F.when(open_gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"{prefix}{kind}_m"),
    ]


def _places(name: str) -> str:
    """SQL for the spans of the matches: lengths are added up in chunks, not one long list."""
    p, m = f"{name}_p", f"{name}_m"
    step = f"""transform({m}, (x, i) -> struct(bigint(length({p}[i])) as gap, bigint(length(x)) as size, x as m, right({p}[i], {BEFORE}) as before))"""
    base = f"aggregate(slice(steps, 1, c * {CHUNK}), 0L, (n, s) -> n + s.gap + s.size)"
    chunk = f"""aggregate(slice(steps, c * {CHUNK} + 1, {CHUNK}),
        struct({base} as at, cast(array() as array<{SPAN}>) as found),
        (a, s) -> struct(a.at + s.gap + s.size as at, concat(a.found, array(struct(a.at + s.gap as start, a.at + s.gap + s.size as end, s.m as m, s.before as before))) as found),
        a -> a.found)"""
    return f"""if(coalesce(size({m}), 0) <= 0, cast(array() as array<{SPAN}>),
        transform(array({step}), steps -> flatten(transform(sequence(0, int((size(steps) - 1) div {CHUNK})), c -> {chunk})))[0])"""


_DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
_LUHN = """transform(array(regexp_replace(s.m, '[^0-9]', '')), d -> aggregate(sequence(1, length(d)), 0,
    (n, i) -> n + transform(array(int(substring(d, i, 1)) * (1 + (length(d) - i) % 2)), x -> if(x > 9, x - 9, x))[0]) % 10 = 0)[0]"""
_SIZED = f"length({_DIGITS}) between 13 and 19"
VALID = {
    "email": "true",
    "ip": r"""forall(split(s.m, '[.]'), x -> transform(array(regexp_replace(x, '^0+(?=[0-9])', '')), y -> length(y) <= 3 and int(y) <= 255)[0])""",
    "card": f"if({_SIZED}, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def _spans(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("*", *[F.expr(_places(n)).alias(f"{n}_s") for n in names])


def _candidate(kind: str, form: int) -> str:
    """SQL for a span with its votes (1, 0 or -1; form is given) and a note of its shape."""
    shape = "concat(least(length(s.m) div 4, 9), ':', least(length(regexp_replace(s.m, '[^0-9]', '')) div 3, 6), ':', if(s.m rlike '[ ().-]', 's', 'n'))"
    return f"""struct('{kind}' as kind, s.start as start, s.end as end, {form} as form,
        if(s.m rlike r"{GAZETTEER[kind]}", 1, -1) as gazetteer, if(s.before rlike r"{CONTEXT[kind]}", 1, 0) as context, {shape} as shape)"""


CANDIDATE = "struct<kind: string, start: bigint, end: bigint, form: int, gazetteer: int, context: int, shape: string>"


def _swept(steps: str, value: str, best: str, none: str) -> str:
    """SQL: the further spans in ``steps``, each with the ``best`` ``value`` of base spans before it.

    Chunk by chunk: the best of each chunk first, then, inside a chunk, from the best of all
    chunks before it. So the work grows with the number of spans.
    """
    step = lambda m: f"if(s.o = 0, {best}({m}, s.{value}), {m})"
    part = f"slice(steps, c * {CHUNK} + 1, {CHUNK})"
    chunks = f"sequence(0, int((size(steps) - 1) div {CHUNK}))"
    before = f"coalesce(array_{'max' if best == 'greatest' else 'min'}(slice(tops, 1, c)), {none})"
    inside = f"""aggregate({part}, struct({before} as m, cast(array() as array<struct<x: {CANDIDATE}, m: bigint>>) as found),
        (a, s) -> struct({step('a.m')} as m, if(s.o = 0, a.found, concat(a.found, array(struct(s.x as x, a.m as m)))) as found),
        a -> a.found)"""
    tops = f"transform({chunks}, c -> aggregate({part}, {none}, (m, s) -> {step('m')}))"
    return f"transform(array({steps}), steps -> transform(array({tops}), tops -> flatten(transform({chunks}, c -> {inside})))[0])[0]"


def _apart() -> str:
    """SQL: the spans of ``loose`` that overlap none of ``base``, by start.

    All spans in order of their starts: one of ``loose`` is apart if no base span before it
    ends later than it starts, and the next one starts no earlier than it ends.
    """
    every = f"""array_sort(concat(
        transform(base, b -> struct(b.start as start, 0 as o, b.end as end, cast(null as {CANDIDATE}) as x)),
        transform(loose, l -> struct(l.start as start, 1 as o, l.end as end, cast(l as {CANDIDATE}) as x))))"""
    left = _swept(every, "end", "greatest", "-1L")
    right = f"reverse({_swept(f'reverse({every})', 'start', 'least', '9223372036854775807L')})"
    kept = f"filter(zip_with({left}, {right}, (l, r) -> struct(l, r)), z -> z.l.m <= z.l.x.start and z.r.m >= z.l.x.end)"
    return f"if(size(loose) = 0 or size(base) = 0, cast(loose as array<{CANDIDATE}>), transform({kept}, z -> z.l.x))"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, loose``: the valid base spans, and further ones to vote on.

    One pass over the texts, row by row; null text counts as empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        *[c for k in KINDS for c in _matches(k, BASE[k], GATES[k], "base_")],
        *[c for k in LOOSE for c in _matches(k, LOOSE[k], GATES[f"loose {k}"], "loose_")],
    )
    rows = _spans(rows, [f"base_{k}" for k in KINDS] + [f"loose_{k}" for k in LOOSE])
    base = [f"transform(filter(base_{k}_s, s -> {VALID[k]}), s -> {_candidate(k, 1)})" for k in KINDS]
    more = [f"transform(loose_{k}_s, s -> {_candidate(k, 0)})" for k in LOOSE]
    more.append(f"transform(filter(base_card_s, s -> {_SIZED} and not {_LUHN}), s -> {_candidate('card', -1)})")
    rows = rows.select("doc_id", F.expr(f"concat({', '.join(base)})").alias("base"), F.expr(f"concat({', '.join(more)})").alias("loose"))
    return rows.select("doc_id", "base", F.expr(_apart()).alias("loose"))


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))])


def _vote(name: str) -> Column:
    return F.concat_ws("|", F.lit(name), "kind", F.col(name).cast("string"))


def _log_odds(params: dict[str, float], keys: list[Column]) -> Column:
    """Sum of the keys' log ratios; a key that was never met says nothing."""
    table = _table(params)
    out = F.coalesce(F.try_element_at(table, F.concat_ws("|", F.lit("prior"), "kind")), F.lit(0.0))
    for key in keys:
        out = out + F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    return out


def _ratios(rows: DataFrame, keys: list[Column]) -> dict[str, float]:
    """Log ratios of each key under the two classes, by the weights ``n`` and ``post``."""
    pairs = rows.select("kind", "n", "post", F.explode(F.array(F.concat_ws("|", F.lit("prior"), "kind"), *keys)).alias("key"))
    sums = pairs.groupBy("kind", "key").agg(F.sum(F.col("n") * F.col("post")).alias("yes"), F.sum(F.col("n") * (1 - F.col("post"))).alias("no")).collect()
    total = {r["kind"]: (r["yes"], r["no"]) for r in sums if r["key"].startswith("prior|")}
    out = {}
    for r in sums:
        yes, no = total[r["kind"]]
        if r["key"].startswith("prior|"):
            out[r["key"]] = log((yes + 1) / (no + 1))
        else:
            out[r["key"]] = log((r["yes"] + 0.5) / (yes + 1.5)) - log((r["no"] + 0.5) / (no + 1.5))
    return out


def fitted(found: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Log ratios of the final classifier, from all candidates.

    Candidates are first counted by kind, votes and shape: a table whose size depends on
    the labelers and shapes alone. On it, expectation-maximisation starts from the share of
    votes for a span and in each round sets a span's odds by the labelers' reliabilities,
    and these by the odds. The classifier is then fitted to the last odds, over votes and
    shapes.
    """
    every = found.select(F.explode(F.concat("base", "loose")).alias("c")).select("c.*")
    counts = staged(every.groupBy("kind", *LABELERS, "shape").agg(F.count("*").cast("double").alias("n")), "votes")
    keys = [_vote(name) for name in LABELERS]
    votes = sum((F.col(name) for name in LABELERS[1:]), F.col(LABELERS[0]))
    odds = 1 / (1 + F.exp(-1.5 * votes))
    for _ in range(rounds):
        odds = 1 / (1 + F.exp(-_log_odds(_ratios(counts.withColumn("post", odds), keys), keys)))
    shape = F.concat_ws("|", F.lit("shape"), "kind", "shape")
    return _ratios(counts.withColumn("post", odds), [*keys, shape])


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id``, counts and ``base_sha256`` of base spans, ``spans``, ``n_added`` and ``n_spans``.

    Base spans follow the patterns and checks of ``BASE`` and ``VALID``; they always stay.
    Further spans (forms such as ``name [at] host.org``, national phone numbers, long IP
    addresses, card numbers with a wrong check digit) are voted on by three labelers (form,
    gazetteer, context), and added if the classifier gives them ``accept`` or more and they
    overlap no base span. Spans are ``kind:start:end`` in code points, end exclusive, by
    kind (email, ip, card, phone) and start. A row for each row of ``docs``; null text
    counts as empty and has no spans; other columns are not read.
    """
    found = staged(candidates(docs), "candidates")
    params = fitted(found)
    table = _table(params)
    score = lambda c: sum(
        (
            F.coalesce(F.try_element_at(table, F.concat_ws("|", F.lit(n), c["kind"], c[n].cast("string"))), F.lit(0.0))
            for n in (*LABELERS, "shape")
        ),
        F.coalesce(F.try_element_at(table, F.concat_ws("|", F.lit("prior"), c["kind"])), F.lit(0.0)),
    )
    added = F.filter("loose", lambda c: 1 / (1 + F.exp(-score(c))) >= accept)
    rows = found.select("doc_id", "base", added.alias("added"))
    texts = "transform(array_sort({}, (a, b) -> case when a.kind != b.kind then field(a.kind) - field(b.kind) when a.start < b.start then -1 when a.start > b.start then 1 else 0 end), s -> concat_ws(':', s.kind, s.start, s.end))"
    place = lambda x: f"array_position(array({', '.join(repr(k) for k in KINDS)}), {x})"
    order = texts.replace("field(a.kind)", f"int({place('a.kind')})").replace("field(b.kind)", f"int({place('b.kind')})")
    joined = lambda what: F.array_join(F.expr(order.format(what)), ",")
    return rows.select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("concat(base, added)").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
