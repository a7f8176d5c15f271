import hashlib
import math
import random
import re

from rigtables.llm import op3_pii as op


def reference(t):
    """The patterns applied as they stand."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for alphabet in ("ab1234567890.@+- ()\n%_", "12.+ -", "a@.b-"):
        for _ in range(20_000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert op.base_spans(t) == reference(t), t


def test_long_runs_take_time_in_proportion():
    for t in ("1" * 300_000, "a." * 150_000, "a@" * 100_000, "+1(" * 100_000, "1." * 100_000 + "x"):
        op.base_spans(t)
    assert op.base_spans("1" * 5000 + ".1.1.1") == [] and op.base_spans("0" * 5000 + "9.1.1.1") == [("ip", 0, 5007)]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op.op3_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    want = expected({k: t or "" for k, t in texts.items()})
    for r in rows:
        terms = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term:")]
        assert {texts[r.doc_id][s:e].lower() for s, e in terms} == want[r.doc_id]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in reference(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def planted(n=60):
    """A surname that stands by one address in varied surroundings, and nowhere else; common words stand everywhere."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(n)]
    for k in range(6):
        texts[k] = " ".join(rng.choices(words, k=12)) + " Zimmerfeld zim@example.org " + " ".join(rng.choices(words, k=12))
    return texts


def expected(texts):
    """(doc, term) by counting over all documents."""
    spans = {k: reference(t) for k, t in texts.items()}
    terms, held = {}, {}
    for k, t in texts.items():
        terms[k] = [m[0].lower() for m in re.finditer(r"[^\W_]+", t) if not any(s < m.end() and m.start() < e for _, s, e in spans[k])]
        held[k] = set()
        for kind, s, e in spans[k]:
            v = t[s:e].lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", t[s:e])
            held[k].add((kind, v))
            heads = {"email": ["@" + v.split("@")[-1], v.split("@")[0] + "@"], "ip": [".".join(v.split(".")[:3]) + "."], "card": [v[:6] + "*"], "phone": [v[:-4] + "*"]}
            held[k] |= {(kind, h) for h in heads[kind]}
    want = {k: set() for k in texts}
    for entity in set().union(*held.values()):
        docs = [k for k in texts if entity in held[k]]
        for term in set().union(*(terms[k] for k in docs)):
            both = [k for k in docs if term in terms[k]]
            if len({tuple(terms[k]) for k in both}) < 2:
                continue
            df = sum(term in x for x in terms.values())
            p = len(docs) / len(texts)
            pmi = math.log((len(both) + 2 * p) / (df + 2) / p)
            if pmi > 1e-12 and pmi >= 0.5 * math.log(len(texts) / len(docs)) - 1e-12:
                for k in both:
                    want[k].add(term)
    return want


def check_terms(texts, df):
    got = {r.doc_id: {texts[r.doc_id][s.start : s.end].lower() for s in r.spans if s.kind == "term"} for r in op.personal_data(df).collect()}
    assert got == expected(texts)
    return got


def test_disclosing_terms_by_brute_force(docs_of):
    texts = planted()
    got = check_terms(dict(enumerate(texts)), docs_of(*texts))
    assert all("zimmerfeld" in got[k] for k in range(6))
    rng = random.Random(9)
    for _ in range(3):
        texts = []
        for _ in range(80):
            words = rng.choices([f"w{k}" for k in range(60)], weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 25))
            words += rng.sample(["ann@x.org", "bob@x.org", "10.0.0.1", "+1 (407) 555-7710", "rare", "Ann", "Bob"], rng.choice([0, 0, 1, 3]))
            rng.shuffle(words)
            texts.append(" ".join(words))
        texts += texts[:10]
        check_terms(dict(enumerate(texts)), docs_of(*texts))


def test_more_terms_than_tasks_know(docs_of, monkeypatch):
    monkeypatch.setattr(op, "COMMON", 4)
    monkeypatch.setattr(op, "HELD", 5)
    texts = planted()
    check_terms(dict(enumerate(texts)), docs_of(*texts))


def test_sanitised_texts(docs_of):
    texts = [*planted(), None, "", "call +1 (407) 555-7710 now"]
    df = docs_of(*texts)
    out = op.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert "[NAME] [EMAIL]" in got[0].text and got[0].n_chars == len(got[0].text)
    assert got[60].text is None and got[61].text == "" and got[62].text == "call [PHONE] now"
    assert all(got[k].text == texts[k] for k in range(6, 60))
    assert op.sanitise(docs_of()).count() == 0


def test_copies_prove_nothing(docs_of):
    texts = ["alpha beta me@example.org gamma delta"] * 5 + [f"other words {k}" for k in range(20)]
    assert all(s.kind != "term" for r in op.personal_data(docs_of(*texts)).collect() for s in r.spans)


def test_terms_of_the_whole_document(docs_of):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    texts = [f"Zimmerfeld {some(20)} Zimmerfeld {some(20)} zim@example.org" for _ in range(6)] + [some(40) for _ in range(54)]
    out = {r.doc_id: r.text for r in op.sanitise(docs_of(*texts)).collect()}
    assert all("Zimmerfeld" not in out[k] and out[k].count("[NAME]") == 2 and "[EMAIL]" in out[k] for k in range(6))
    assert all(out[k] == texts[k] for k in range(6, 60))


def test_a_fixed_signature_line_is_judged(docs_of):
    rng = random.Random(8)
    some = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(20))
    line = "\nregards and many thanks from Zimmerfeld zim@example.org Hauptweg street house number nine\n"
    texts = [some() + line + some() for _ in range(6)] + [some() for _ in range(54)]
    out = [r.text for r in op.sanitise(docs_of(*texts)).collect()]
    assert not any("Zimmerfeld" in t or "Hauptweg" in t for t in out)


def test_ids_survive_another_split(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(k, f"text {k} me{k}@example.org " + "x" * k, "s") for k in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        docs = spark.read.parquet(path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")
        out = op.sanitise(docs)  # jobs run here; the rest is planned under another split
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = {r.doc_id: r.text for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: f"text {k} [EMAIL] " + "x" * k for k in range(64)}


def test_classes_of_values():
    assert op.protected("email", "Ann.B@Mail.example.org") == ["email:ann.b@mail.example.org", "email:@mail.example.org", "email:ann.b@"]
    assert op.protected("ip", "10.0.0.17") == ["ip:10.0.0.17", "ip:10.0.0."]
    assert op.protected("phone", "+1 (407) 555-7710") == ["phone:14075557710", "phone:1407555*"]
    assert op.protected("card", "4952 9359 0025 3052") == ["card:4952935900253052", "card:495293*"]


def test_a_domain_is_given_away_by_terms_of_unlike_addresses(docs_of):
    rng = random.Random(4)
    some = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(20))
    texts = [f"{some()} Hauptwerk person{k}@hauptwerk.example {some()}" for k in range(6)] + [some() for _ in range(54)]
    got = check_terms(dict(enumerate(texts)), docs_of(*texts))
    assert all("hauptwerk" in got[k] for k in range(6))


def test_a_list_of_ten_thousand_addresses_makes_no_product(spark, docs_of, monkeypatch):
    addresses = " ".join(f"m{k}@d{k % 7}.example.org" for k in range(10_000))
    texts = [f"{addresses} " + " ".join(f"{a}{k}" for k in range(500)) + f" list {a}" for a in ("one", "two")] + [f"other {k}" for k in range(30)]
    rows = {}
    write = op.written

    def counting(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(op, "written", counting)
    found = op.personal_data(docs_of(*texts)).collect()
    assert rows["pairs"] <= 2 * 502
    assert [len([s for s in r.spans if s.kind == "email"]) for r in sorted(found)[:2]] == [10_000] * 2
    assert {texts[r.doc_id][s.start : s.end] for r in found for s in r.spans if s.kind == "term"} == {"list"}
