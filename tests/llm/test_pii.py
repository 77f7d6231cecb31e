"""Personal data against Python's own patterns and counts."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import regex
from area_trends.llm import pii, queries

#: the plain forms
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    out = [
        (m.start(), k, m.end(), m.group())
        for k, kind in enumerate(PLAIN)
        for m in re.finditer(PLAIN[kind], text)
        if valid(kind, m.group())
    ]
    return sorted(out)


def near_terms(rows, reach=100, contexts=3, at=0.75):
    """Base spans of each row, the pairs (kind, value, term) that tell by their places, and the places of all pairs."""
    together, seen = Counter(), defaultdict(set)
    found, places, words = [], [], Counter()
    for row, (_, text) in enumerate(rows):
        text = text or ""
        spans = base(text)
        found.append(spans)
        words.update(regex.findall(r"\p{L}{3,}", text.lower()))
        met = set()
        for start, kind, end, value in spans:
            line = text.rfind("\n", 0, start) + 1, (text + "\n").index("\n", end)
            low, high = max(start - reach, 0), min(end + reach, len(text))
            terms, sides = [], [text[max(line[0], low) : start], text[end : min(line[1], high)]]
            for m in regex.finditer(r"\p{L}+", text):
                a, b = m.span()
                if b - a < 3 or a < line[0] or b > line[1] or a < low or b > high or (a < end and start < b):
                    continue
                if not any(s < b and a < e for s, _, e, _ in spans):
                    terms.append((m.group().lower(), a, b))
            if sides and low > 0:
                cut = regex.match(r"\p{L}+", text[low:start])
                sides[0] = text[max(line[0], low + (cut.end() if cut else 0)) : start]
            if end + reach < len(text):
                cut = regex.search(r"\p{L}+$", text[end:high])
                sides[1] = text[end : min(line[1], end + cut.start() if cut else high)]
            for term, a, b in terms:
                pair = (kind, value, term)
                seen[pair].add(tuple(sides))
                if (pair, a) not in met:
                    met.add((pair, a))
                    together[pair] += 1
                places.append((row, pair, a, b))
    total, value_near = sum(words.values()), Counter()
    for (kind, value, _), n in together.items():
        value_near[kind, value] += n
    told = set()
    for pair, n in together.items():
        if len(seen[pair]) >= contexts:
            near = value_near[pair[:2]]
            if total > near:
                told_by = math.log2(n * total / (words[pair[2]] * near)) / math.log2(total / near)
                if told_by >= at - 1e-12:
                    told.add(pair)
    return found, told, places


def brute(rows, **options):
    """The first way alone."""
    found, told, places = near_terms(rows, **options)
    terms = defaultdict(set)
    for row, pair, a, b in places:
        if pair in told:
            terms[row].add((a, 4, b))
    yield from listed(rows, found, terms)


def least_share(hits, tries):
    square, share = 1.96**2, hits / tries
    spread = 1.96 * math.sqrt(share * (1 - share) / tries + square / (4 * tries * tries))
    return (share + square / (2 * tries) - spread) / (1 + square / tries)


def brute_both(rows, at=0.75):
    """Both ways: by the places near a value, and by the different texts that hold both."""
    found, told, _ = near_terms(rows, at=at)
    texts = {text or "" for _, text in rows}
    outside = {}
    for text in texts:
        spans = base(text)
        words = [(m.group().lower(), *m.span()) for m in regex.finditer(r"\p{L}{3,}", text)]
        outside[text] = [w for w in words if not any(s < w[2] and w[1] < e for s, _, e, _ in spans)]
    holders, with_term = defaultdict(set), Counter()
    for text in texts:
        with_term.update(set(regex.findall(r"\p{L}{3,}", text.lower())))
        for _, kind, _, value in base(text):
            holders[kind, value].add(text)
    revealing = defaultdict(set)  # terms of each text
    for (kind, value), held in holders.items():
        together = Counter(t for text in held for t in {w[0] for w in outside[text]})
        for term, n in together.items():
            known = math.log2(len(texts) / len(held))
            by_texts = math.log2(least_share(n, with_term[term]) * len(texts) / len(held)) / known if known else 0
            if by_texts >= at or (kind, value, term) in told:
                for text in held:
                    revealing[text].add(term)
    terms = {
        row: {(a, 4, b) for word, a, b in outside[text or ""] if word in revealing[text or ""]} if found[row] else set()
        for row, (_, text) in enumerate(rows)
    }
    yield from listed(rows, found, terms)


def listed(rows, found, terms):
    for row, (doc_id, _) in enumerate(rows):
        spans = [(a, k, b) for a, k, b, _ in found[row]]
        text = lambda s: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
        counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
        digest = hashlib.sha256(text(spans).encode()).hexdigest()
        yield (doc_id, *counts, len(terms[row]), digest, text(sorted([*spans, *terms[row]])))


ODD = """x@y a@b.c_d@e.f a.b@c-d.e..f @a.b a@b. +1 (234) 555-0199. +1 234 +12345678901234567890 ++1234567890
1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 99999999999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112
4111111111111111 41111111111111111111 5500 0000 0000 0004 é漢@x.yz u%+-@1.2 12  34 0000 0000 0000 a@b.c@d.e"""


def test_base_spans(spark):
    rows = [(0, ODD), (1, None), (2, ""), (3, "9" * 30_000), (4, "a" * 50_000 + "@b.c"), (5, "1 " * 20_000)]
    rows += [(6 + i, ODD[i:] + " é" + ODD[: i * 2]) for i in range(0, 200, 7)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    assert sorted(map(tuple, pii.personal_data(docs).collect())) == sorted(brute(rows))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    found = sorted(map(tuple, queries.op6_personal_data(spark, sf).collect()))
    assert found == sorted(brute(rows))
    assert any(r[-1] for r in found)


def test_terms_that_reveal(spark):
    rows = [(i, f"line {i} before\nask Zebulon about plan {chr(97 + i) * 4} at zeb@corp.example now") for i in range(5)]
    rows += [(100 + i, f"the plan was about a line of {chr(97 + i % 26) * 5} and now at rest, ask before") for i in range(60)]
    rows += [(200, "copied Quixote wrote q@corp.example"), (201, "copied Quixote wrote q@corp.example"), (202, "copied Quixote wrote q@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pii.personal_data(docs).collect())) == sorted(brute(rows))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "line 0 before\nask  about plan aaaa at [EMAIL] now"
    assert clean[200] == "copied Quixote wrote [EMAIL]"
    assert clean[100] == rows[5][1]


def test_native(spark, sf):
    plan = queries.op6_personal_data(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_far_from_values(spark):
    """A value met in two texts, the name on another line or far off, and once more in the text."""
    far = " ".join(["some words between that tell nothing"] * 5)
    rows = [(0, f"written by Zebulon\n{far}\nzeb@corp.example {far}"), (1, f"mail to zeb@corp.example, {far} said Zebulon. So Zebulon")]
    rows += [(10 + i, f"{far} written by someone, said mail {i}") for i in range(400)]
    rows += [(900 + i, f"{far} another text without any address {i}") for i in range(400)]
    rows += [(2000, f"Quixote wrote it\n{far}\nfrom q@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all(not any(p.startswith("term") for p in row[-1].split(",")) for row in brute(rows))
    places = lambda i: [f"term:{m.start()}:{m.end()}" for m in re.finditer("Zebulon", rows[i][1])]
    assert [p for p in found[0].spans.split(",") if p.startswith("term")] == places(0)
    assert [p for p in found[1].spans.split(",") if p.startswith("term")] == places(1) and found[1].n_term == 2
    assert "term:0:7" in found[2000].spans.split(",")  # a value met once
    assert all(not found[i].n_term for i in range(10, 410))


def test_both_ways_against_brute_force(spark):
    """Values in one, two and many texts, with names that go with them, others that do not, and copies."""
    rng = random.Random(5)
    common = [f"w{''.join(rng.choices('abcdefg', k=4))}" for _ in range(60)]
    rows = []
    for i in range(900):
        text = " ".join(rng.choices(common, k=rng.randint(3, 25)))
        if i % 9 == 0:
            value = rng.choice([f"p{i % 40}@corp.example", f"10.0.0.{i % 30}", "shared@corp.example"])
            name = f"Name{chr(97 + i % 20)}{chr(97 + i % 7)}"
            text = rng.choice([f"{name} {text}\n{value}", f"{text} {value} {name}", f"{text} {value}", f"{name}\n{text} {value} {name}"])
        rows.append((i, text))
        if i % 45 == 0:
            rows.append((5000 + i, text))
    rows += [(9000, None), (9001, ""), (9002, "one@corp.example"), (9003, "one@corp.example two@corp.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, expected = sorted(map(tuple, pii.personal_data(docs).collect())), sorted(brute_both(rows))
    assert found == expected
    assert found != sorted(brute(rows))
    assert sum(r[5] for r in found) > 20


def test_places_of_many_matches(spark):
    """Matches are placed piece by piece: around the bounds of pieces, and in a text of a megabyte."""
    for n in (0, 1, pii.PIECE - 1, pii.PIECE, pii.PIECE + 1, 3 * pii.PIECE, 5000):
        text = "".join(f"{'é' * (i % 3)} wörd{'x' * (i % 5)}" for i in range(n))
        found = spark.createDataFrame([(text,)], "text string").select(pii.located(pii.F.col("text"), pii.TERMS).alias("x"))
        expected = [(m.start(), m.end(), m.group()) for m in regex.finditer(r"\p{L}{3,}", text)]
        assert [tuple(s) for s in found.first()["x"]] == expected
    words = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta\n"], k=170_000))
    long = spark.createDataFrame([(1, f"a@b.cd {words}"), (2, "x")], "doc_id long, text string")
    start = time.monotonic()
    assert {r.doc_id: r.n_email for r in pii.personal_data(long).collect()} == {1: 1, 2: 0}
    assert len(words) > 950_000 and time.monotonic() - start < 60
