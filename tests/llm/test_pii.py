import hashlib
import math
import random
import re
import time

from tessera.llm import pii

KINDS = ("email", "ip", "card", "phone")


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(m):
    total = 0
    for i, c in enumerate(reversed(digits(m))):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


STATED = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(m)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def stated(text):
    found, counts = [], []
    for k, (pattern, good) in enumerate(STATED):
        own = [m for m in re.finditer(pattern, text) if good(m.group())]
        found += [(m.start(), k, f"{KINDS[k]}:{m.start()}:{m.end()}") for m in own]
        counts.append(len(own))
    return counts, [x[2] for x in sorted(found)]


def test_base_spans_equal_the_stated_patterns(make):
    r = random.Random(3)
    alphabet = [*"ab1234567890.@-+ ()%_é🙂\n", "4539148803436467", "1.2.3.4", "a@b.co", "+49 30 ", "0000255.1.1.1"]
    given = ["".join(r.choices(alphabet, k=r.randint(0, 80))) for _ in range(1500)]
    given += [None, "", "1" * 300 + " 4539 1488 0343 6467x", "a@b.c_d@e.f.g", "a" * 50_000 + "@", "1." * 30_000, "+1" + "( " * 3000 + "2345678 90", "a@b.co " * 2000, "a@b" + ".c" * 20_000]
    rows = pii.personal_data(make(list(enumerate(given)), parts=4)).collect()
    assert len(rows) == len(given)
    for x in rows:
        counts, spans = stated(given[x["doc_id"]] or "")
        assert [x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]] == counts
        assert x["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in x["spans"].split(",") if s.split(":")[0] in KINDS] == spans


def test_odd_texts(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == 14 and all(x["spans"] == "" and x["base_sha256"] == hashlib.sha256(b"").hexdigest() for x in rows)
    assert pii.personal_data(none).collect() == []
    assert pii.redact(none, pii.Model()).columns == none.columns


def test_the_method_adds_what_labelers_back(make):
    good = [(k, f"Please call my phone ({200 + k % 700}) {300 + k % 600}-1234 or write") for k in range(60)]
    bad = [(100 + k, f"model part no 111-{100 + k % 99}-0000 in version list") for k in range(20)]
    model = pii.fit(pii.proposals(make(good + bad)))
    rows = {x["doc_id"]: x["spans"] for x in pii.personal_data(make(good + bad), model).collect()}
    assert sum("phone_local" in rows[k] for k, _ in good) >= 50
    assert not any(rows[k] for k, _ in bad)
    assert model.reliability["phone_local", 0] > 0.8


def test_redaction(make):
    docs = make([(1, "Mail a@b.co, call +49 30 1234567 or 10.0.0.1!"), (2, "nothing"), (3, None), (3, "🙂 a@b.co a@b.co")])
    rows = pii.redact(docs, pii.Model())
    assert rows.columns == docs.columns
    got = sorted((x["doc_id"], x["text"], x["n_chars"]) for x in rows.collect())
    assert got == [(1, "Mail <EMAIL>, call <PHONE> or <IP>!", 35), (2, "nothing", 7), (3, "", 0), (3, "🙂 <EMAIL> <EMAIL>", 17)]


def test_spelled_out_addresses_in_either_bracket(make):
    spelled = ["jane (at) example (dot) com", "jane [at] example [dot] com", "jane(AT)example(DOT)com", "jane [AT] mail (dot) example [DOT] com"]
    docs = make([(k, f"Contact me by email: {t}") for k, t in enumerate(spelled * 30)])
    proposed = pii.proposals(docs)
    for r in proposed.collect():
        text = spelled[r["doc_id"] % 4]
        assert [(v["kind"], v["s"], v["e"]) for v in r["__votes"]] == [("email_spelled", 21, 21 + len(text))]
    model = pii.fit(proposed)
    assert all(r["n_added"] == 1 for r in pii.personal_data(docs, model).collect())
    assert {r["text"] for r in pii.redact(docs, model).collect()} == {"Contact me by email: <EMAIL_SPELLED>"}


def test_expectation_maximisation_finds_the_poor_labeler():
    r, patterns = random.Random(7), {}
    for _ in range(4000):
        y = r.random() < 0.4
        p = tuple((1 if (y if r.random() < a else not y) else -1) for a in (0.95, 0.9, 0.55))
        patterns[p] = patterns.get(p, 0) + 1
    _, share, right = pii.expectation_maximisation(patterns)
    assert abs(share - 0.4) < 0.05 and abs(right[0] - 0.95) < 0.04 and abs(right[1] - 0.9) < 0.04 and right[2] < 0.62


def test_check_digits_and_lists(make):
    """Votes of the format's rules and of the gazetteers by kind."""
    given = {
        "account GB82 WEST 1234 5698 7654 32 there": ("iban", 1, 1), "account GB82 WEST 1234 5698 7654 33 there": ("iban", -1, 1), "account DE89 3704 0044 0532 0130 00 there": ("iban", 1, 1), "account QQ89 3704 0044 0532 0130 00 x": ("iban", -1, -1),
        "ssn 078-05-1120": ("ssn", 1, -1), "ssn 123-45-6789": ("ssn", 1, 1), "ssn 666-45-6789": ("ssn", -1, 1), "ssn 740-45-6789": ("ssn", 1, 0),
        "to a@b.de": ("email", 1, 1), "to a@b.zzz": ("email", 1, 0), "call +44 20 7946 0958": ("phone", 1, 1), "call +28 20 7946 0958": ("phone", 1, 0), "Dr. Julia Weber": ("name", 0, 1), "Dr. Ugluk Weber": ("name", 0, 0),
    }
    texts = list(given)
    for r in pii.proposals(make(list(enumerate(texts)))).collect():
        kind, form, listed = given[texts[r["doc_id"]]]
        own = [(v["v1"], v["v2"]) for v in r["__votes"] if v["kind"] == kind]
        assert own == [(form, listed)], texts[r["doc_id"]]


def plain_added(rows):
    """Spans that the method adds to each row, in plain code, from the votes and features of its proposals."""
    every = [v for r in rows for v in r["__votes"]]
    out = {r["doc_id"]: [] for r in rows}
    for kind in {v["kind"] for v in every} - set(KINDS):
        own = [v for v in every if v["kind"] == kind]
        votes = [(v["v1"], v["v2"], v["v3"]) for v in own]
        p = [(1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v in votes]
        for _ in range(50):
            share = (sum(p) + 1) / (len(p) + 2)
            odds = [math.log(share / (1 - share))] * len(p)
            for k in range(3):
                chance = {}
                for y in (0, 1):
                    mass = {x: (1.0 if x == 0 or (x > 0) == y else 0.25) + sum((q if y else 1 - q) for q, v in zip(p, votes, strict=True) if v[k] == x) for x in (-1, 0, 1)}
                    chance[y] = {x: m / sum(mass.values()) for x, m in mass.items()}
                odds = [o + math.log(chance[1][v[k]] / chance[0][v[k]]) for o, v in zip(odds, votes, strict=True)]
            new = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
            moved, p = max(abs(a - b) for a, b in zip(new, p, strict=True)), new
            if moved < 1e-6:
                break
        tables = {}
        for v, q in zip(own, p, strict=True):
            for name in ("v1", "v2", "v3", "shape", "words", "pairs"):
                for value in v[name] if name in ("words", "pairs") else [v[name]]:
                    c = tables.setdefault(name, {}).setdefault(value, [1.0, 1.0])
                    c[0] += q
                    c[1] += 1 - q
        score = lambda name, value, t=tables: math.log(t[name][value][0] / sum(c[0] for c in t[name].values())) - math.log(t[name][value][1] / sum(c[1] for c in t[name].values()))
        for r in rows:
            for v in r["__votes"]:
                if v["kind"] == kind and not any(b["kind"] in KINDS and b["s"] < v["e"] and v["s"] < b["e"] for b in r["__votes"]):
                    total = math.log(share / (1 - share)) + sum(score(n, v[n]) for n in ("v1", "v2", "v3", "shape"))
                    total += sum(sum(score(n, x) for x in v[n]) / len(v[n]) for n in ("words", "pairs") if v[n])
                    assert abs(total) > 1e-6
                    if total >= 0:
                        out[r["doc_id"]].append((v["kind"], v["s"], v["e"]))
    return {d: sorted(x) for d, x in out.items()}


def test_added_spans_equal_plain_code(make):
    r = random.Random(8)
    number = lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}"
    parts = [
        lambda: f"call my phone {number()}", lambda: f"part no {number()} in version list", lambda: f"contact jane [at] site{r.randint(1, 9)} [dot] {r.choice(['com', 'de', 'qqq'])}", lambda: f"ssn {r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        lambda: f"order {r.randint(100, 999)}-{r.randint(10, 99)}-0000", lambda: f"Dear {r.choice(['Mr', 'Dr', 'Frau'])} {r.choice(['Julia', 'Ugluk', 'Peter'])} {r.choice(['Weber', 'Stone'])}", lambda: r.choice(["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 31", "ISBN XY12 ABCD EFGH 1234 5678"]),
        lambda: "mail a@b.co", lambda: f"+49 30 {r.randint(1000000, 9999999)}", lambda: "10.0.0.1", lambda: "and then", lambda: "4539148803436467",
    ]
    docs = make([(k, r.choice([" ", ", ", "\n"]).join(r.choice(parts)() for _ in range(r.randint(0, 9)))) for k in range(500)])
    want = plain_added(pii.proposals(docs).collect())
    got = {}
    for x in pii.personal_data(docs).collect():
        spans = [s.split(":") for s in x["spans"].split(",") if s]
        got[x["doc_id"]] = sorted((k, int(s), int(e)) for k, s, e in spans if k not in KINDS)
        assert x["n_added"] == len(got[x["doc_id"]]) and x["n_spans"] == len(spans)
    assert got == want and sum(map(len, got.values())) > 100


def test_many_spans_in_one_text(make):
    """A text with 100,000 addresses, some of other kinds among them, is read and redacted in a time that follows its length."""
    text = " ".join(f"u{k}@b.co 10.0.{k % 256}.1 555-{k % 900 + 100}-1234" if k % 4 == 0 else f"ünd{k}@b.co" for k in range(100_000))
    docs = make([(1, text), (2, "plain")], parts=1)
    began = time.perf_counter()
    row = {x["doc_id"]: x for x in pii.personal_data(docs).collect()}[1]
    counts, spans = stated(text)
    assert [row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]] == counts and counts[0] == 100_000
    assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    clean = {x["doc_id"]: x["text"] for x in pii.redact(docs, pii.Model()).collect()}[1]
    assert clean == re.sub(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "<IP>", re.sub(r"[A-Za-z0-9]+@b\.co", "<EMAIL>", text))
    assert time.perf_counter() - began < 90


def test_the_plan_is_native(make, spark, sf):
    docs = make([(1, "x")])
    for frame in (pii.with_hits(docs), pii.proposals(docs), pii.redact(docs, pii.Model()), pii.op2_pii(spark, sf)):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
