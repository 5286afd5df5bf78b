import base64
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from fieldmill.llm import bpe, exact_dedup, html_text, packing, pii, quality, simhash, substring_dedup, token_output, topk  # noqa: E402

LONG = " ".join(f"w{i}" for i in range(9000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    "hello  world", "hello world", "hello\tworld", None, "", "   ", LONG, LONG + " end", "a" * 5000, "é日本 <|endoftext|>\u0085x", PASSAGE, "start " + PASSAGE + " stop", "one two",
    "mail a.b@c.example.org or 10.0.0.1, 256.1.1.1, card 4111 1111 1111 1111, call +1 (555) 123-4567 x@y.z.q_r@s.tu", "hello world",
    "rare 😀😀 ok\u1c89\u2e80x  \U000105c0y ꟍ1",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(1, "hello world", "x", 1), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _t string, _words long")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_bpe_is_the_librarys(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs, path, P.PATTERN, with_ids=True).collect()
    assert len(got) == docs.count()
    for r in got:
        t = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(t) and r["decoded_sha256"] == sha(t)


def test_substring_dedup_against_brute_force(docs):
    seen = {}
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for i, t in enumerate(TEXTS)}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            seen.setdefault(tuple(words[i][j : j + 13]), i)
    for hot in (2, 1024):
        for r in substring_dedup.remove_repeats(docs.where("doc_id IS NOT NULL"), bits=16, hot=hot).collect():
            w = words[r["doc_id"]]
            gone = {j + k for j in range(len(w) - 12) if seen[tuple(w[j : j + 13])] < r["doc_id"] for k in range(13)}
            assert (r["n_words"], r["n_removed"]) == (len(w), len(gone)) and r["kept_sha256"] == sha(" ".join(x for j, x in enumerate(w) if j not in gone))


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[norm(r["text"])].append(r["doc_id"])
    for r in exact_dedup.mark_copies(docs).collect():
        g = groups[norm("null id" if r["doc_id"] is None else TEXTS[r["doc_id"]])]
        least = min((x for x in g if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(g), r["doc_id"] == least)
    assert exact_dedup.deduplicate(docs).count() == len(groups)
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0


def test_exact_dedup_of_groups_over_many_partitions(spark):
    """Copies that share their first characters, in groups larger than a partition, with and without null identifiers."""
    lead = "the same long beginning of every one of these texts "
    texts = [lead + ("a" if i % 3 else f"b{i % 40} " + "z " * (i % 7)) for i in range(3000)] + [None, "", "other"] * 5
    rows = [(None if i % 500 == 7 else i, t) for i, t in enumerate(texts)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    of = {i: norm(t) for i, t in rows if i is not None}
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.mark_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            g = groups[of[r["doc_id"]]]
            least = min(x for x in g if x is not None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(g), r["doc_id"] == least)


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(docs.where("doc_id <> 1"), P.path("byte_bpe_50k.json"), length=64, group_docs=4, with_ids=True)
    rows = got.collect()
    for i, text in enumerate(TEXTS):
        if i != 1:
            mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
            ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in mine), "<u4").tolist()
            assert ids == t.encode(text or "", add_special_tokens=False).ids + [0]
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.sequences(got).count() == len({r["sequence_id"] for r in rows})
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r["doc_id"]].add(r["sequence_id"] >> 32)
    assert {len(g) for g in groups.values()} == {1} and len(set.union(*groups.values())) > 1


def test_token_output(spark, docs, tmp_path):
    out = token_output.materialise(docs, P.path("byte_bpe_50k.json"), length=32, shard_rows=8)
    rows = sorted(out.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows))) and {len(r["payload"]) for r in rows} == {64}
    assert [r["byte_offset"] for r in rows[:9]] == [64 * i for i in range(8)] + [0]
    for n in (1, 2, 5, 1000):
        f = token_output.Feistel(n, b"k")
        s = f.slots(np.arange(n))
        assert sorted(s) == list(range(n)) and (f.indexes(s) == np.arange(n)).all()
    token_output.write_shards(out, str(tmp_path / "s"))
    assert [r["slot"] for r in token_output.read_from(spark, str(tmp_path / "s"), 10, 8).collect()] == list(range(10, len(rows)))


def test_simhash_against_brute_force(docs):
    got = simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    ids, comp = sorted(fp), {}
    for i in ids:
        comp[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fp[a] ^ fp[b]).count("1") <= 3 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    assert {r["doc_id"]: r["component_id"] for r in got} == comp and fp[3] == fp[4] == 0


def test_similar_documents(spark):
    base = [f"x{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"y{i}" for i in range(200))), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(rows).collect()} == {1, 3, 4}


def test_similar_documents_finds_cut_inserted_and_appended_copies(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for i in range(40):
        n = (12, 60, 200, 700)[i % 4]
        w = [f"v{x}" for x in rng.integers(0, 3000, n)] if i % 5 else [f"v{x}" for x in rng.integers(0, 3000, n)] + [f"shared{x}" for x in range(30)]
        at = len(w) // 2
        copies = [w, w[: len(w) - len(w) // 9], w[:at] + [f"in{i}x{x}" for x in range(len(w) // 9)] + w[at:], [*w, "last"], w[: len(w) // 2]]
        texts |= {i * 10 + j: " ".join(c) for j, c in enumerate(copies)}
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    pairs = [(a, b) for a in texts for b in texts if a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    assert {(a % 10, b % 10) for a, b in pairs} >= {(0, 1), (0, 2), (0, 3)}
    want = {x: x for p in pairs for x in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def candidates(spark, texts):
    """All pairs of the texts, and those that are left before sets of shingles are read."""
    found = simhash.profiles(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").where("node IS NOT NULL")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a > b], "src long, dst long")
    left = simhash.alike(simhash.possible(pairs, found.drop("fps", "map", "shard", "part", "counts")), found.select("node", "size", "map"))
    return {(r["src"], r["dst"]) for r in left.collect()}


def test_sets_are_read_of_pairs_only_that_can_be_similar(spark):
    w = [f"w{i}" for i in range(3000)]
    texts = {1: w, 2: [*w[:1500], "other", *w[1501:]], 3: [f"o{i}" for i in range(3000)], 4: w[:600], 5: w[:60], 6: [*w[:1500], *(f"n{i}" for i in range(1500))]}
    assert candidates(spark, {i: " ".join(x) for i, x in texts.items()}) == {(2, 1)}


def test_parities_of_long_texts_lose_no_similar_pair(spark):
    texts = {}
    for n in (512, 513, 640, 641, 1024, 1025, 1280, 1281, 2561):
        w = [f"w{n}x{i}" for i in range(n + 4)]
        least = -(-4 * n // 5)
        for copy in (w, w[: least + 4], w[: least + 3], [*w[: n // 2], *(f"in{n}x{i}" for i in range(n // 5)), *w[n // 2 :]], w[n // 12 :]):
            texts[len(texts)] = copy
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in texts.items()}
    want = {(a, b) for a in texts for b in texts if a > b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])}
    assert {(a % 5, b % 5) for a, b in want} >= {(1, 0), (4, 0), (2, 1)} and (2, 0) not in {(a % 5, b % 5) for a, b in want}
    assert want <= candidates(spark, {i: " ".join(w) for i, w in texts.items()})


@pytest.mark.parametrize("most", [-1, simhash.BROADCAST_ROWS])
def test_near_copies_go_whether_identifiers_are_broadcast_or_not(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    w = " ".join(f"w{i}" for i in range(100))
    rows = spark.createDataFrame([(1, w), (2, w + " end"), (2, w + " end"), (3, "else"), (None, w)], "doc_id long, text string")
    out = simhash.keep_one(rows)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3]
    assert ("strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 20))
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 20), (303, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(256 * np.vstack([v, v[:1]])).astype(int)
    ids = [*range(300), 303]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), query_block=3, block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert len(got) == 6
    for i, found in got.items():
        want = sorted(((-int(q[j] @ q[i]), ids[j]) for j in range(301) if ids[j] != i))[:5]
        assert found == [(b, -a) for a, b in want]


def test_pii_base_and_disclosed_terms(docs, spark):
    r = pii.find_spans(docs.where("doc_id = 13")).first()
    t = TEXTS[13]
    assert [t[s["start"] : s["end"]] for s in r["base"]] == ["a.b@c.example.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.z.q", "_r@s.tu"]
    rows = [(i, f"note {i} written by Zebulon at z@x.org about item n{i}") for i in range(8)] + [(100 + i, f"note {i} about items written elsewhere") for i in range(60)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zebulon" not in out[0] and "[EMAIL]" in out[0] and "written" in out[0] and out[100] == rows[8][1]


def test_pii_terms_of_whole_texts(spark):
    far = "filler words " * 20
    with_name = [(i, f"Zebulon opens text {i} for z@x.org. " + far + ("Zebulon ends" if i % 2 else "nothing ends")) for i in range(4)]
    without_name = [(10 + i, f"other text {i} for z@x.org. " + far) for i in range(6)]
    distant = [(20 + i, f"call q@x.org about {i}. " + far + "then ask Quillon or quillon") for i in range(4)]
    rows = with_name + without_name + distant + [(100 + i, f"other text {i} opens and ends with nothing, then call about, ask for {far}") for i in range(80)]
    rows += [(200, "a quillon in a text of its own")] + [(201 + i, "q@x.org alone, note %d" % i) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not [i for i, t in out.items() if "Zebulon" in t]  # in 40% of the entity's texts, at the start of texts and far from it
    assert not [i for i, t in out.items() if "uillon" in t] and out[200] == "a [WORD] in a text of its own"
    assert out[100] == dict(rows)[100] and "filler words" in out[0]
    spans = {r["doc_id"]: r["all_spans"] for r in pii.find_spans(df).where("doc_id IN (1, 20)").collect()}
    assert [dict(rows)[1][s["start"] : s["end"]] for s in spans[1]] == ["Zebulon", "z@x.org", "Zebulon"]
    assert [dict(rows)[20][s["start"] : s["end"]] for s in spans[20]] == ["q@x.org", "Quillon", "quillon"]

def brute_spans(text):
    """The base spans by plain search, kind by kind."""
    import re

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([ -]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_pii_base_spans_against_brute_force(spark):
    import random

    draw = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", "10.0.0.1", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44 20 7946 0958", "12", " ", ".", "-", "\u00e4\U0001f600", "word", "+", "\n"]
    texts = ["".join(draw.choice(bits) + draw.choice(["", " ", ", "]) for _ in range(draw.randrange(25))) for _ in range(400)] + [None, "", " ".join(f"u{i}@h{i}.org 10.0.{i % 300}.7" for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find_spans(df).collect()}
    assert len(got) == len(texts) and all(got[i] == brute_spans(t or "") for i, t in enumerate(texts))


@pytest.mark.parametrize("term", [pii.TERM, r"[\p{L}\p{N}]+"])
def test_pii_disclosure_against_brute_force(spark, monkeypatch, term):
    """PMI and IC over documents with planted names, counted in plain Python, for terms of four characters and of any length."""
    import math

    import regex

    monkeypatch.setattr(pii, "TERM", term)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] or "" for r in table.where("n_chars < 4000").orderBy("doc_id").limit(350).collect()]
    plants = [("Lee Zebu wrote to x@y.org", 6), ("mail q@r.net or Ona of Quillonia", 4), ("Marn Odd, w@w.io", 2), ("+1 (555) 123-4567 is Bo Ravenhold", 3)]
    at = 0
    for plant, times in plants:
        for _ in range(times):
            texts[at] += "\n" + plant
            at += 1
    texts[340:345] = [texts[0]] * 5
    texts[345] += " Ravenhold"

    def found(text):
        spans = brute_spans(text)
        chars = list(text)
        for _, start, end in spans:
            chars[start:end] = "\x01" * (end - start)
        entity = lambda kind, x: kind + ":" + (x.lower() if kind in ("email", "ip") else regex.sub("[^0-9]", "", x))
        return {entity(k, text[a:b]) for k, a, b in spans}, {w.lower() for w in regex.findall(term, "".join(chars))}

    whole = [found(t) for t in set(texts)]
    n_e, n_t, n_et = collections.Counter(), collections.Counter(), collections.Counter()
    for entities, words in whole:
        n_e.update(entities)
        n_t.update(words)
        n_et.update((e, w) for e in entities for w in words)
    want = {}
    for (e, w), n in n_et.items():
        if n >= pii.SUPPORT and pii.SUPPORT <= n_e[e] < len(whole):
            share = 1.0 if n == n_t[w] else math.log2(n * len(whole) / (n_e[e] * n_t[w])) / math.log2(len(whole) / n_e[e])
            if share >= pii.GENERALISE:
                want[e, w] = "removed" if share >= pii.REMOVE else "generalised"
    rows = pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("key", "base", "terms").dropDuplicates(["key"])
    got = {(r["entity"], r["term"]): r["action"] for r in pii.disclosing(rows).collect()}
    assert got == want and ("email:x@y.org", "zebu") in got and ("email:q@r.net", "quillonia") in got
    assert (("email:x@y.org", "lee") in got) == (term != r"[\p{L}\p{N}]{4,}")


def test_pii_replaces_overlaps_whole_and_keeps_other_columns(spark):
    far = "x" * 3000
    rows = [(1, f"{far} 4111 1111 1111 1111@x.org {far} 10.0.0.1", "a", 1), (1, f"{far} 4111 1111 1111 1111@x.org {far} 10.0.0.1", "a", 1), (2, None, "b", None), (None, "plain", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _row int")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    clean = f"{far} [CARD] {far} [IP]"
    assert got == sorted([(1, clean, "a", 1), (1, clean, "a", 1), (2, None, "b", None), (None, "plain", None, 2)], key=str)
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.find_spans(df.limit(0)).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>One<br>two <b>bold</b>ly<p>three</article><div id=comments>No</div><footer>F</footer>"
    rows = spark.createDataFrame([(1, "http://h.example/a", page), (2, "http://h.example/b", None), (3, None, "<p>plain"), (1, "http://h.example/a", page)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract_text(rows).collect())
    assert got == [(1, "Head & more One two boldly three")] * 2 + [(2, ""), (3, "plain")]

def test_html_wrapper_decides_where_names_do_not(spark):
    menu = "<div class=x3><span>Start</span><div>Kontakt</div></div>"
    article = lambda i: "".join(f"<p>Story {i} sentence {j} tells of number {i * j + 7} at some length and more.</p>" for j in range(6))
    page = lambda i: f"<html><body>{menu}<div class=x1><h1>Title {i}</h1>{article(i)}<p>All rights kept here</p></div>" + (f"<div class=x9><p>Buy thing {i} now</p></div>" if i % 3 else "") + "</body></html>"
    want = lambda i: " ".join([f"Title {i}", *(f"Story {i} sentence {j} tells of number {i * j + 7} at some length and more." for j in range(6)), "All rights kept here"])
    rows = [(i, f"http://plain.example/{i}", page(i), "x") for i in range(12)] + [(50, "http://alone.example/", page(50), "x"), (51, None, None, "x"), (52, "http://plain.example/e", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _t string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(got[i] == want(i) for i in range(12)) and got[51] == got[52] == ""
    assert "Kontakt" in got[50] and want(50) in got[50]  # one page alone shows no template
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_keeps_what_all_articles_of_a_host_share_and_articles_with_a_class_of_boilerplate(spark):
    dish = lambda i: f"<header>Kitchen</header><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>flour {i} and water {i}</p><h2>Method</h2><p>bake it {i} minutes</p></article><div class='site-footer'>All dishes</div>"
    rows = [(i, f"http://dish.example/{i}", dish(i)) for i in range(12)] + [(50, "http://law.example/", "<article class='legal-news'><p>The court spoke.</article><div class=cookie-banner>We use cookies</div>"), (51, "http://law.example/b", "<main class=widget><p>Kept</main><div class='news-legal'>Gone</div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Dish {i} Ingredients flour {i} and water {i} Method bake it {i} minutes" for i in range(12))
    assert got[50] == "The court spoke." and got[51] == "Kept"


def test_html_of_all_pages_equals_a_plain_reader_of_articles(spark):
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        blocks = set("article address blockquote body br dd div dl dt figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table tbody td th tr ul".split())
        skipped = set("script style noscript template svg iframe textarea select nav header footer aside form menu dialog button fieldset head title".split())

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.off, self.out = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.off += tag in self.skipped
            if tag in self.blocks:
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.depth -= tag == "article" and self.depth > 0
            self.off -= tag in self.skipped and self.off > 0
            if tag in self.blocks:
                self.out.append("\n")

        def handle_data(self, data):
            if self.depth and not self.off:
                self.out.append(data)

    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html_text.op7_html_extraction(spark, folder).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        if "<article" in (page or ""):
            reader = Reader()
            reader.feed(page)
            reader.close()
            assert got[i] == " ".join(" ".join(reader.out).split()) or got[i].split() == "".join(reader.out).split(), i


def test_html_groups_and_slots():
    pages = ["<div><p>a</p><p>b</p></div>", "<div><p>a</p><ul><li>x</li></ul></div>"]
    wrapper = html_text.wrapper_of([html_text.read(x)[1] for x in pages])
    assert wrapper == (("div", 0, (("p", 0, (("#",),), html_text.REPEATED), ("ul", 0, (("li", 0, (("#",),), 0),), html_text.OPTIONAL)), 0),)


@pytest.mark.parametrize("page", ["<div>" * 20000 + "hello" + "</div>" * 20000, "<a " * 33000, "<script " * 12000, "<b>" * 20000 + "<p>x" * 5000, "<div>" * 20000 + "</b>" * 20000 + "x"])
def test_html_is_linear_in_odd_pages(page):
    import time

    began = time.time()
    assert html_text.extract(page, [], set())
    assert time.time() - began < 5


def test_quality(spark):
    good = "This is a line of ordinary words, which go on.\nAnother line follows it here."
    bad = "BUY!! NOW!! CHEAP!! STUFF!!\nWOW!! WOW!! WOW!!"
    docs = spark.createDataFrame([(i, (bad if i % 3 == 0 else good) + f" n{i}") for i in range(120)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i]["predicted"] == (i % 3 != 0) for i in range(120)) and 0 <= got[500]["score"] <= 1
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_token_shards_hold_the_tokenizers_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = token_output.materialise(docs, P.path("byte_bpe_50k.json"), length=32, shard_rows=8)
    token_output.write_shards(out, str(tmp_path / "s"))
    rows = token_output.read_shards(spark, str(tmp_path / "s")).collect()
    got = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["payload"], "<u2")
        assert not ids[r["n_tokens"] :].any()
        got[r["doc_id"]].append((r["start"], tuple(ids[: r["n_tokens"]].tolist())))
    want = collections.defaultdict(list)
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want[r["doc_id"]] += [(i, tuple(ids[i : i + 32])) for i in range(0, len(ids), 32)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    folder = tmp_path / "bin"
    folder.mkdir()
    shards = {r["shard"]: r["rows"] for r in token_output.export_bin(out, str(folder)).collect()}
    by_slot = {r["slot"]: bytes(r["payload"]) for r in rows}
    for k, n in shards.items():  # a reader that resumes at the third sequence of a shard
        with open(folder / f"shard-{k:08d}.bin", "rb") as f:
            f.seek(2 * 64)
            assert f.read() == b"".join(by_slot[8 * k + i] for i in range(2, n))
    empty = token_output.materialise(docs.limit(0), P.path("byte_bpe_50k.json"))
    assert empty.count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    draw = np.random.default_rng(3)
    field = quality.Field(draw.normal(size=quality.WIDTH), draw.normal(size=(2, 2)), np.array([1.0, 0.0]))
    sizes = [1, 4, 2, 6, 3]
    at = np.concatenate([[0], np.cumsum(sizes)])
    unary = draw.normal(size=at[-1])
    p, moved = field.lines(unary, at)
    expected = np.zeros((2, 2))
    for d, n in enumerate(sizes):
        u, total, good, seen = unary[at[d] : at[d + 1]], 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u[i] for i in range(n) if path[i]) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            good += w * np.array(path)
            for a, b in zip(path, path[1:]):
                seen[a, b] += w
        assert np.allclose(p[at[d] : at[d + 1]], good / total)
        expected += seen / total
    assert np.allclose(moved, expected)


def test_names_that_clash_and_scores_that_overflow(spark):
    text = "ordinary words, which go on.\nAnother line."
    df = spark.createDataFrame([(1, text, "a", "b"), (2, text, "c", "d"), (2, text, "c", "d")], "doc_id long, text string, _t string, _sha string")
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, text, "a", "b")]
    scored = quality.score(df, quality.fit([]))
    assert scored.columns == [*df.columns, "_score", "_predicted"] and scored.count() == 3
    with pytest.raises(ValueError):
        quality.score(scored, quality.fit([]))
    vectors = spark.createDataFrame([(0, [1e12, 2.0]), (1, [1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(vectors, vectors).collect()
    twice = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice, twice.where("vec_id = 0")).collect()] == [(0, 1, 1, -65536)]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = P.path("byte_bpe_50k.json")
    assert substring_dedup.remove_repeats(none).count() == packing.pack(none, path).count() == simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(vectors, vectors).count() == 0
