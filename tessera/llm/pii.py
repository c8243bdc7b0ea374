"""Personal data by weak supervision, in DataFrame functions only.

Spans of four base kinds come from fixed patterns and checks. Looser patterns propose further spans (local phone numbers, spelled-out addresses, social
security and bank account numbers, titled names). On every proposed span three labelers vote for, against or not at all: the format's
own rules and check digits, gazetteers (top-level domains, countries' account lengths, calling codes, given names), and the words before it. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability by kind without any label; its posteriors, as soft labels, train a naive Bayes classifier over what the labelers don't tell as well: the span's
length and surroundings, hashed words of its context and hashed pairs of character classes in it, beside the votes. The classifier decides which further
spans are added; base spans stay.

Texts are walked a fixed number of times, and the work on a text's spans grows with their number (times its logarithm): running sums go over slices
of BLOCK spans, spans that meet base spans are found by bisection. What comes to the driver: one row for each vote pattern or feature value, of which
there are a fixed number.

Edge cases: a null text counts as empty; a text without spans has zero counts, the hash of the empty string and ""; repeated rows
each get their row; an empty table gives an empty result and a model that adds nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import carrying, table, text_or_empty, written

#: The base kinds in order. Each pattern finds what the stated one does: it begins where a run begins, takes runs whole and so never backs up.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "email_spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}){1,4}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
EXTRA = tuple(k for k in PATTERNS if k not in BASE)
KINDS = (*BASE, *EXTRA)
#: A character that every match of a kind has, looked for first.
HAS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
DIGITS = "regexp_replace(m, '[^0-9]', '')"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CHECKS = {
    "email": "true",
    "ip": rf"m rlike '^{OCTET}(?:[.]{OCTET}){{3}}$'",
    "card": f"length({DIGITS}) <= 19 and luhn_check({DIGITS})",
    "phone": f"length({DIGITS}) between 9 and 15",
}
# The gazetteers.
#: Common top-level domains.
DOMAINS = """com org net edu gov mil int info biz name pro io ai app dev co me tv eu ac ad ae ag al am ar at au az ba be bg bo br by ca ch cl cn cr cu cy cz de dk do dz ec ee eg es fi fr ge gr gt
hk hn hr hu id ie il in iq ir is it jo jp ke kr kw kz lb li lk lt lu lv ma mc md mk mt mx my ng ni nl no np nz om pa pe ph pk pl pt py qa ro rs ru sa se sg si sk sm sn sv sy th tn tr tw ua uk us uy uz va ve vn za""".split()
#: Characters of an international bank account number by country.
ACCOUNT_LENGTHS = dict(x.split(":") for x in """AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28
HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VA:22 XK:20""".split())
#: Calling codes of countries.
CALLING_CODES = """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 233 234 254 255 256 260 263 350 351 352 353 354 355 356 357 358 359
370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 501 502 503 504 505 506 507 509 591 592 593 594 595 597 598 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998""".split()
#: Given names in four languages.
GIVEN_NAMES = """Alexander Alice Andreas Andrew Angela Anna Anne Antonio Barbara Ben Bernard Brigitte Carlos Carmen Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Diana Elena Elizabeth Emily Emma Eric Eva Felix Fernando
Francisco François Frank Frédéric George Gerard Hans Heinrich Helen Helga Henry Ingrid Isabel Jack Jacques James Jan Jane Jean Jennifer Jessica Johann John Jorge José Josef Juan Julia Julie Karen Karl Kate Katharina Klaus Laura Laurent Linda
Louis Luis Lukas Manuel Marc Margaret Maria María Marie Mark Markus Martin Mary Matthew Max Michael Michel Miguel Monika Nathalie Nicolas Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Pilar Rafael Richard Robert Rosa Ruth Sabine
Sandra Sarah Sergio Simon Sofia Sophie Stefan Stephen Susan Susanne Sylvie Thomas Ursula Vincent Walter Werner William Wolfgang""".split()
#: Social security numbers that were printed in advertisements.
PRINTED = ("078-05-1120", "219-09-9999", "457-55-5462")

# Labelers by kind, as SQL over m (the span) and ctx (what stands before it, up to CONTEXT characters).
CONTEXT = 40
PLAIN_IBAN = "upper(replace(m, ' ', ''))"
#: The remainder by 97 of an account number whose first four characters stand behind the rest; letters count from 10 on.
MOD_97 = (
    f"aggregate(split(concat(substring({PLAIN_IBAN}, 5), left({PLAIN_IBAN}, 4)), ''), 0, (r, c) -> "
    "case when c between '0' and '9' then (r * 10 + cast(c as int)) % 97 when c between 'A' and 'Z' then (r * 100 + ascii(c) - 55) % 97 else r end)"
)
FORMAT = {
    "email": "case when m rlike '[.][A-Za-z]{2,24}$' and not m rlike '^[.]|[.][.]|[.]@' then 1 else -1 end",
    "ip": "case when m rlike '(^|[.])0[0-9]' then -1 else 1 end",
    "card": "case when m rlike '^[3-6][0-9 -]{13,22}$' then 1 when m rlike '^0' then -1 else 0 end",
    "phone": "case when m rlike '^[+][1-9]' then 1 else -1 end",
    "phone_local": "case when m rlike '^[(]?[2-9][0-9]{2}[)]?[ .-]?[2-9]' then 1 else -1 end",
    "email_spelled": "case when m rlike '[A-Za-z]{2,24}$' then 1 else -1 end",
    "ssn": "case when m rlike '^(000|666|9)|-00-|-0000$' then -1 else 1 end",
    "iban": f"case when {MOD_97} = 1 then 1 else -1 end",
    "name": "case when m rlike '[a-z]{2}$' then 0 else -1 end",
}


def _one_of(words: list[str], value: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"array_contains(array({listed}), {value})"


GAZETTEER = {
    "email": f"case when {_one_of(DOMAINS, "lower(substring_index(m, '.', -1))")} then 1 else 0 end",
    "ip": "case when m rlike '^(0|127|255)[.]' then -1 when m rlike '^(10|192[.]168)[.]' then 0 else 1 end",
    "card": "case when m rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65)' then 1 else 0 end",
    "phone": f"case when {' or '.join(_one_of([c for c in CALLING_CODES if len(c) == n], f'left({DIGITS}, {n})') for n in (1, 2, 3))} then 1 else 0 end",
    "phone_local": "case when m rlike '^[(]?(800|888|877|866|900)' then -1 else 0 end",
    "email_spelled": f"case when {_one_of(DOMAINS, "lower(regexp_extract(m, '([A-Za-z]+)$', 1))")} then 1 else 0 end",
    "ssn": f"case when {_one_of(list(PRINTED), 'm')} then -1 when left(m, 3) <= '733' or left(m, 3) between '750' and '772' then 1 else 0 end",
    "iban": f"case when element_at(map({', '.join(f"'{c}', {n}" for c, n in ACCOUNT_LENGTHS.items())}), left({PLAIN_IBAN}, 2)) = length({PLAIN_IBAN}) then 1 else -1 end",
    "name": f"case when {_one_of(GIVEN_NAMES, "split(m, ' ')[1]")} then 1 else 0 end",
}
CUES = {
    "email": "e-?mail|contact|write|reach|@|kontakt|courriel|correo|from:|to:",
    "ip": "ip|address|host|server|client|login|from",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|contact|whatsapp|llam|anruf",
    "phone_local": "phone|tel|call|mobile|fax|contact|whatsapp|llam|anruf",
    "email_spelled": "e-?mail|contact|write|reach|kontakt|courriel|correo",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "name": "dear|contact|signed|by|regards|sincerely|patient|customer|client",
}
AGAINST = "version|release|isbn|order|invoice|chapter|section|ticket|model|part no"
ADD_FROM = 0.5
HIT = "struct<s:int,e:int,m:string,ctx:string>"
#: Elements of an array that a running sum goes over at a time, buckets of hashed features, and code points of a chunk of text.
BLOCK, BUCKETS, CHUNK = 256, 64, 1024


def scanned(items: str, value: str, combine: str, made: str, kind: str) -> str:
    """SQL for ``made`` of each element x of ``items``, where a.at combines (``a + b`` or the like) ``value`` of the elements before it.

    It goes over slices, each with what the slices before it come to: an array that grows is copied at every step, so none may grow long.
    """
    with_next = lambda at: combine.replace("$a", at).replace("$b", f"({value})")
    starts = f"aggregate(parts, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, part) -> named_struct('at', aggregate(part, a.at, (t, x) -> {with_next('t')}), 'out', array_append(a.out, a.at)), a -> a.out)"
    inside = f"aggregate(part, named_struct('at', start, 'out', cast(array() as array<{kind}>)), (a, x) -> named_struct('at', {with_next('a.at')}, 'out', array_append(a.out, {made})), a -> a.out)"
    slices = f"transform(sequence(0, greatest(size(xs) - 1, 0) div {BLOCK}), k -> slice(xs, cast(k * {BLOCK} + 1 as int), {BLOCK}))"
    # an array of one element binds a name, so that what it stands for is worked out once
    return f"element_at(transform(array({items}), xs -> element_at(transform(array({slices}), parts -> flatten(zip_with(parts, {starts}, (part, start) -> {inside}))), 1)), 1)"


def found(text: str, kind: str) -> Column:
    """Every match of the kind's pattern in a column of texts, leftmost and non-overlapping, with its place in code points.

    ``split`` gives what lies between the matches, so places are running sums of lengths.
    """
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    items = f"arrays_zip(split({text}, '{pattern}', -1), regexp_extract_all({text}, '{pattern}', 0))"
    begin = "a.at + length(x.`0`)"
    hit = f"named_struct('s', {begin}, 'e', {begin} + coalesce(length(x.`1`), 0), 'm', x.`1`, 'ctx', right(x.`0`, {CONTEXT}))"
    hits = f"filter({scanned(items, 'length(x.`0`) + coalesce(length(x.`1`), 0)', '$a + $b', hit, HIT)}, h -> h.m is not null)"
    there = f"contains({text}, '{HAS[kind]}') and " if kind in HAS else ""
    return F.expr(f"case when {there}{text} rlike '{pattern}' then {hits} else cast(array() as array<{HIT}>) end")


def _scoped(sql: str, lam: str) -> str:
    """``sql`` over m and ctx, of the hit that the lambda's variable names."""
    return re.sub(r"'(?:[^'\\]|\\.)*'|\b(m|ctx)\b", lambda x: f"{lam}.{x[1]}" if x[1] else x[0], sql)


def with_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column of hits for each kind; base kinds without those that fail their check."""
    docs = docs.withColumns({f"__hit_{k}": found(text, k) for k in KINDS})
    return docs.withColumns({f"__hit_{k}": F.expr(f"filter(__hit_{k}, h -> {_scoped(CHECKS[k], 'h')})") for k in BASE})


def votes() -> Column:
    """The proposed spans of a row, by kind and start, as an array of kind, s, e, the three votes and the features that are no votes; base kinds are included."""
    parts = []
    for k in KINDS:
        context = f"case when lower(ctx) rlike '({CUES[k]})' then 1 when lower(ctx) rlike '({AGAINST})' then -1 else 0 end"
        shape = "concat(least(3, floor(length(m) / 8)), if(ctx rlike '(^|[ \\\\n(]|: ?)$', 's', 'o'))"
        words = f"array_distinct(transform(regexp_extract_all(lower(ctx), '[\\\\p{{L}}]++', 0), w -> cast(pmod(xxhash64(w), {BUCKETS}) as int)))"
        classes = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[0-9]', '0'), '[\\\\p{Lu}]', 'A'), '[\\\\p{Ll}]', 'a'), '(.)\\\\1+', '$1')"
        pairs = f"array_distinct(transform(regexp_extract_all({classes}, '(?=(..))', 1), w -> cast(pmod(xxhash64(w), {BUCKETS}) as int)))"
        v = [_scoped(x, "h") for x in (FORMAT[k], GAZETTEER[k], context, shape, words, pairs)]
        parts.append(
            f"transform(__hit_{k}, h -> named_struct('kind', '{k}', 's', h.s, 'e', h.e, 'v1', cast({v[0]} as int), 'v2', cast({v[1]} as int), 'v3', cast({v[2]} as int), 'shape', {v[3]}, 'words', {v[4]}, 'pairs', {v[5]}))"
        )
    return F.expr(f"concat({', '.join(parts)})")


@dataclass(frozen=True)
class Model:
    """Log odds of the classifier: ``prior`` by kind, ``weight`` by 'kind|feature|value'; reliability: the labelers' estimated accuracy."""

    prior: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, int], float] = field(default_factory=dict)


def expectation_maximisation(patterns: dict[tuple[int, int, int], int], rounds: int = 50) -> tuple[dict[tuple[int, int, int], float], float, list[float]]:
    """The posterior of each vote pattern, the share of true spans and the labelers' accuracies where they vote.

    Starts from the share of votes for; a Beta-like count of one keeps chances off 0 and 1.
    """
    post = {p: (1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p in patterns}
    share, chance = 0.5, {}
    for _ in range(rounds):
        total = sum(patterns.values())
        true = sum(n * post[p] for p, n in patterns.items())
        share = (true + 1) / (total + 2)
        for k in range(3):
            for y in (0, 1):
                mass = {v: sum(n * (post[p] if y else 1 - post[p]) for p, n in patterns.items() if p[k] == v) for v in (-1, 0, 1)}
                # a vote for is likelier on true spans, to begin with: which side is "true" stays fixed
                lean = {-1: 1.0 if not y else 0.25, 0: 1.0, 1: 1.0 if y else 0.25}
                whole = sum(mass.values()) + sum(lean.values())
                chance[k, y] = {v: (mass[v] + lean[v]) / whole for v in mass}
        new = {}
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[k, 1][p[k]] / chance[k, 0][p[k]]) for k in range(3))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[p] - post[p]) for p in patterns), default=0.0)
        post = new
        if moved < 1e-6:
            break
    right = []
    for k in range(3):
        voted = sum(n for p, n in patterns.items() if p[k])
        agree = sum(n * (post[p] if p[k] > 0 else 1 - post[p]) for p, n in patterns.items() if p[k])
        right.append((agree + 1) / (voted + 2))
    return post, share, right


def _table(values: dict, kind: str = "double") -> str:
    return "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in values.items()) + ")" if values else f"cast(map() as map<string, {kind}>)"


def log_odds(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Of each value of a feature, from its soft counts on true and on false spans, with one added to each."""
    n_yes, n_no = (sum(c[y] for c in counts.values()) + len(counts) for y in (0, 1))
    return {v: math.log((yes + 1) / n_yes) - math.log((no + 1) / n_no) for v, (yes, no) in counts.items()}


def fit(proposed: DataFrame) -> Model:
    """A model from a table with the column ``__votes``: one aggregation counts vote patterns, for expectation-maximisation, one the features under its posteriors."""
    each = proposed.select(F.explode("__votes").alias("c")).select("c.*")
    rows = each.groupBy("kind", "v1", "v2", "v3").count().collect()
    prior, weight, reliability, posterior = {}, {}, {}, {}
    for kind in KINDS:
        patterns = {(r["v1"], r["v2"], r["v3"]): r["count"] for r in rows if r["kind"] == kind}
        if patterns:
            post, share, right = expectation_maximisation(patterns)
            prior[kind] = math.log(share / (1 - share))
            reliability |= {(kind, k): x for k, x in enumerate(right)}
            posterior |= {f"{kind}|{'|'.join(map(str, p))}": x for p, x in post.items()}
    if not prior:
        return Model()
    truth = f"element_at({_table(posterior)}, concat_ws('|', kind, v1, v2, v3))"
    single = ", ".join(f"named_struct('name', '{n}', 'value', cast({n} as string))" for n in SINGLE)
    several = ", ".join(f"transform({n}, w -> named_struct('name', '{n}', 'value', cast(w as string)))" for n in SEVERAL)
    features = each.select("kind", F.expr(truth).alias("p"), F.explode(F.expr(f"concat(array({single}), {several})")).alias("f"))
    sums = features.groupBy("kind", "f.name", "f.value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    counts: dict[tuple[str, str], dict] = {}
    for r in sums:
        counts.setdefault((r["kind"], r["name"]), {})[r["value"]] = (r["yes"], r["no"])
    for (kind, name), values in counts.items():
        weight |= {f"{kind}|{name}|{v}": x for v, x in log_odds(values).items()}
    return Model(prior, weight, reliability)


#: Features with one value, and those with several, of which the mean counts: they depend on each other.
SINGLE, SEVERAL = ("v1", "v2", "v3", "shape"), ("words", "pairs")


def added(model: Model, least: float = ADD_FROM) -> Column:
    """The further spans that the classifier takes, without those that meet a base span."""
    bound = math.log(least / (1 - least))
    of = lambda name, value: f"coalesce(element_at({_table(model.weight)}, concat(c.kind, '|{name}|', {value})), 0D)"
    terms = [of(n, f"c.{n}") for n in SINGLE]
    terms += [f"if(size(c.{n}) = 0, 0D, aggregate(c.{n}, 0D, (t, w) -> t + {of(n, 'w')}) / size(c.{n}))" for n in SEVERAL]
    score = f"coalesce(element_at({_table(model.prior)}, c.kind), -1000D) + {' + '.join(terms)}"
    base = ", ".join(f"'{k}'" for k in BASE)
    # spans of a kind are sorted and apart, so of those that begin before this one's end the last reaches furthest
    last = "aggregate(array(" + ", ".join(str(1 << k) for k in reversed(range(30))) + "), 0, (low, n) -> if(get(xs, low + n - 1).s < c.e, low + n, low))"
    bases = "array(" + ", ".join(f"filter(__votes, b -> b.kind = '{k}')" for k in BASE) + ")"
    meets = f"exists(bases, xs -> coalesce(get(xs, {last} - 1).e > c.s, false))"
    return F.expr(f"element_at(transform(array({bases}), bases -> filter(__votes, c -> c.kind not in ({base}) and {score} >= {bound!r}D and not {meets})), 1)")


def _as_text(spans: str) -> str:
    """'kind:start:end', comma-joined, by start and then by kind in the order of KINDS."""
    numbers = "map(" + ", ".join(f"'{k}', {n}" for n, k in enumerate(KINDS)) + ")"
    ordered = f"array_sort(transform({spans}, c -> named_struct('s', c.s, 'n', element_at({numbers}, c.kind), 'e', c.e, 'kind', c.kind)))"
    return f"array_join(transform({ordered}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')"


def proposals(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id alone by default) of each row, and its proposed spans in ``__votes``; null texts count as empty."""
    keep = ["doc_id"] if keep is None else keep
    given = docs.select(*[F.col(c) for c in keep if c != text], text_or_empty(text).alias(text))
    return with_hits(given, text).select(*keep, votes().alias("__votes"))


def personal_data(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_added and n_spans (all) of every row; fits a model on ``docs`` if none is given."""
    rows = written(proposals(docs, text), "proposals")
    model = fit(rows) if model is None else model
    base = ", ".join(f"'{k}'" for k in BASE)
    rows = rows.withColumn("__added", added(model)).withColumn("__base", F.expr(f"filter(__votes, c -> c.kind in ({base}))"))
    counts = [F.expr(f"cast(size(filter(__base, c -> c.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return rows.select(
        "doc_id", *counts, F.expr(f"sha2({_as_text('__base')}, 256)").alias("base_sha256"), F.expr(_as_text("concat(__base, __added)")).alias("spans"), F.size("__added").cast("long").alias("n_added"), (F.size("__base") + F.size("__added")).cast("long").alias("n_spans")
    )


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets; where spans meet, the first one's. A null text becomes empty; n_chars, if there, follows.

    Without a model one is fitted on ``docs``, whose proposed spans are written for it, without their texts. Other columns stay as they are, whatever their names.
    """
    return carrying(docs, lambda d: _redacted(d, model, text), ("doc_id", "lang", "source", "n_chars", text))


def _redacted(docs: DataFrame, model: Model | None, text: str) -> DataFrame:
    base = ", ".join(f"'{k}'" for k in BASE)
    model = fit(written(proposals(docs, text, []), "proposals")) if model is None else model
    rows = proposals(docs, text, docs.columns)
    rows = rows.withColumn("__added", added(model)).withColumn("__taken", F.expr(f"array_sort(transform(concat(filter(__votes, c -> c.kind in ({base})), __added), c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind)))"))
    # a span that begins inside one before it is a part of that
    parts = scanned("__taken", "x.e", "greatest($a, $b)", f"if(x.s < a.at, null, named_struct('from', a.at, 's', x.s, 'kind', x.kind))", "struct<from:int,s:int,kind:string>")
    parts = f"filter({parts}, x -> x is not null)"
    # what stands between spans is cut out of a chunk of the text: out of the text itself each cut would walk it from its start
    i, j = f"x.from div {CHUNK}", f"x.s div {CHUNK}"
    head, tail = f"substring(get(chunks, cast({i} as int)), cast(x.from % {CHUNK} + 1 as int))", f"coalesce(substring(get(chunks, cast({j} as int)), 1, cast(x.s % {CHUNK} as int)), '')"
    between = f"if({i} = {j}, coalesce(substring(get(chunks, cast({i} as int)), cast(x.from % {CHUNK} + 1 as int), x.s - x.from), ''), concat({head}, array_join(slice(chunks, cast({i} + 2 as int), cast({j} - {i} - 1 as int)), ''), {tail}))"
    chunks = f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"
    marked = f"element_at(transform(array({chunks}), chunks -> array_join(transform({parts}, x -> concat({between}, '<', upper(x.kind), '>')), '')), 1)"
    clean = f"concat({marked}, substring({text}, array_max(transform(__taken, x -> x.e)) + 1))"
    rows = rows.withColumn(text, F.expr(f"case when size(__taken) = 0 then {text} else {clean} end"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
