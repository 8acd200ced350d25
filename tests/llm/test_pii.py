"""Base spans against the patterns themselves; the vote on the others."""

import hashlib
import random
import re

from lathe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 8 <= len(digits) <= 15
            if kind == "card" and 16 <= len(digits) <= 19:
                total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
                ok = total % 10 == 0
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choices(["@", ".", "a", "b-", "%", "1", "25", "4539 5787", " ", "-", "+", "(", ")", "é", "256", "0", "4111111111111111", "x@y.z", "1.2.3.4"], k=rng.randint(1, 25)))
        assert sorted(pii.base_spans(text)) == plain(text), text
    assert pii.base_spans("a" * 200000 + "@" + "1" * 200000 + "+1" * 50000) == []  # in linear time


def test_long_digits_and_many_spans(spark):
    """Zeros without end in an address, and texts with very many spans."""
    text = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(text) == [(1, 0, len(text))] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    many = "mail me at a@b.co now or call (415) 555-1234 today " * 20000  # 1 MB
    df = spark.createDataFrame([(1, text), (2, many)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]] == [("ip", 0, len(text))]
    assert sum(s["kind"] == "email" for s in got[2]) == 20000


def test_further_spans():
    """A spelled-out address's local part is whole; candidates that overlap are decided as by trying them one by one."""
    local = "x" * 300
    assert pii.more_spans(f"to {local} (at) mail (dot) org") == [(4, 3, 3 + len(f"{local} (at) mail (dot) org"))]
    assert pii.more_spans("(at) b.org") == []
    rng = random.Random(4)
    for _ in range(3000):
        spans = lambda n: [(rng.randint(0, 3), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(n))]  # noqa: B023, E731
        base, more = spans(rng.randint(0, 4)), []
        for k, s, e in sorted((k + 4, s, e) for k, s, e in spans(rng.randint(0, 6))):
            if not any(k == x and s < z and y < e for x, y, z in more):
                more.append((k, s, e))
        taken, want = [(s, e) for _, s, e in base], []
        for k, s, e in more:
            if not any(s < y and x < e for x, y in taken):
                want.append((k, s, e))
                taken.append((s, e))
        assert pii.apart(base, more) == want


def test_query(spark):
    rows = [(i, f"my name is Anna Smith, mail a{i}@x.com or b{i} (at) mail (dot) org, call (415) 555-{1000 + i} phone, ssn 123-45-{2000 + i} social") for i in range(40)]
    rows += [(100 + i, f"order 555-{i:03d}-1234 version 1.2.3.4 sample 000-00-0000 \U0001f600 ip 10.0.0.{i}") for i in range(40)]
    rows += [(1, "x@y.zz"), (1, "x@y.zz"), (None, "x@y.zz"), (300, None), (301, ""), (302, "w " * 100000 + "+49 30 1234567")]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, spans string")
    out = pii.digest(pii.personal_data(df)).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        spans = plain(t or "")
        want.setdefault(i, []).append((tuple(sum(k == x for k, *_ in spans) for x in range(4)), hashlib.sha256(",".join(f"{pii.BASE[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    for r in out:
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) in want[r["doc_id"]]
    of = {r["doc_id"]: r["spans"] for r in out}
    assert all("name:" in of[i] and "email_spelled:" in of[i] and "phone_national:" in of[i] for i in range(2, 40))
    assert pii.personal_data(df.limit(0)).collect() == []
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df.where("doc_id >= 2")).collect()}
    assert clean[2].startswith("my name is [name], mail [email] or [email_spelled], call [phone_national]") and clean[300] is None and clean[302].endswith("w [phone]")


def test_reliability():
    """A labeler that agrees with the others is found reliable, a random one not."""
    rng, counts = random.Random(2), {}
    for _ in range(4000):
        y = rng.random() < 0.5
        vote = lambda right: "+" if (rng.random() < right) == y else "-"  # noqa: B023, E731
        key = (8, vote(0.95) + vote(0.9) + vote(0.9) + vote(0.5) + vote(0.85), "1ss1")
        counts[key] = counts.get(key, 0) + 1
    m = pii.SpanModel(sorted((*k, n) for k, n in counts.items()))
    assert m.reliability["name", "check"] > 0.9 > 0.6 > m.reliability["name", "counter_cue"]
    assert m.probability(8, "+++-+", "1ss1") > 0.9 > 0.1 > m.probability(8, "---+-", "1ss1")
