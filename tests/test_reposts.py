import pytest
from pyspark.sql import functions as F

from fieldmill.functions import text
from fieldmill.operators import reposts as R

CODE, MAIL, PHONE, AGENCY, MAP = "PROPERTY_CODE:A1", "EMAIL:a@b.co", "PHONE:+85512345678", "AGENCY_CODE:Z9", "MAPS_URL:https://maps.app.goo.gl/x"


@pytest.mark.parametrize(
    ("case", "want"),
    [
        (dict(s=0.1, same_hash=True), ("content_hash", 1.0)),
        (dict(s=0.1, same_hash=True, words=1), None),
        (dict(s=0.55, same_url=True), ("source_url", 0.97)),
        (dict(s=0.54, same_url=True), None),
        (dict(s=0.99, same_print=True), ("text_fingerprint", 0.99)),
        (dict(s=0.5, same_print=True, chars=24), None),
        (dict(s=0.72, shared=[CODE]), ("property_code", 0.72 + 0.28 * 0.72)),
        (dict(s=0.80, shared=[MAIL, PHONE]), None),  # contacts alone describe an agent
        (dict(s=0.74, shared=[MAP, MAIL]), ("multiple_identifiers", 0.68 + 0.30 * 0.74)),
        (dict(s=0.74, shared=[MAP, AGENCY]), ("multiple_identifiers", 0.68 + 0.30 * 0.74)),
        (dict(s=0.73, shared=[MAP, MAIL]), None),
        (dict(s=0.86, same_author=True), ("author_text", 0.70 + 0.30 * 0.86)),
        (dict(s=0.90, shared=[PHONE]), ("contact_text", 0.97)),
        (dict(s=0.86, same_author=True, words=4), None),
        (dict(s=0.95), ("text_only", 0.95)),
        (dict(s=0.95, words=5), None),
        (dict(s=0.99, shared=[AGENCY]), None),  # one agency's wording
        (dict(s=0.99, shared=[AGENCY], same_url=True), ("source_url", 0.99)),
        (dict(s=0.99, shared=[AGENCY, CODE]), ("property_code", 0.99)),
        (dict(s=0.90, shared=[AGENCY, PHONE]), ("contact_text", 0.97)),
    ],
)
def test_rules_and_the_veto(spark, case, want):
    c = dict(s=0.0, words=8, chars=60, same_hash=False, same_url=False, same_print=False, same_author=False, shared=[]) | case
    shared = F.array(*map(F.lit, c.pop("shared"))).cast("array<string>")
    got = spark.range(1).select(R.decision(shared=shared, **{k: F.lit(v) for k, v in c.items()}).alias("r")).first()["r"]
    assert (got is None) if want is None else (got["method"] == want[0] and got["confidence"] == pytest.approx(want[1]))


def test_an_authors_posts_share_pivots_in_slices_and_short_numbers_are_no_signals(spark):
    rows = [(i, "", "", "ann", f"word{i} 12 345", ["word%d" % i, "12", "345"], None) for i in range(200)] + [(900, "", "", None, "", [], None)]
    items = spark.createDataFrame(rows, "id long, content_hash string, url string, author string, norm string, tokens array<string>, identifiers array<string>")
    signals = R.signals(items)
    authors = signals.where("signal LIKE 'author:%'").groupBy("signal").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    assert sorted(tuple(r) for r in authors.collect()) == [("author:ann#0", 0, 80), ("author:ann#1", 80, 80), ("author:ann#2", 160, 40)]
    assert signals.where("signal = 'token:12'").count() == 0 and signals.where("signal = 'token:345'").count() == 200 and signals.where("id = 900").count() == 0


def test_pairs_are_those_that_all_pairs_of_candidates_give(spark):
    base = "sunny two storey villa near the river with garden parking and a large kitchen for families".split()
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(reversed(base)), " ".join(base[:9]), "garden", " ".join(base) + " extra words here", "quite another flat in town, small and cheap with one bed"]
    rows = [(i, f"h{t}", "", "ann" if i % 2 else "bob", t, None) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "id long, content_hash string, url string, author string, norm string, identifiers array<string>").withColumn("norm", text.normalise_repost(F.col("norm")))
    items = items.withColumn("tokens", text.tokens(F.col("norm")))
    got = {(r["a"], r["b"]): r["method"] for r in R.repost_pairs(items).collect()}

    def grams(t):
        return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 2 else {t}

    words = {r["id"]: (set(r["tokens"]), r["norm"]) for r in items.collect()}
    want = set()
    for a in words:
        for b in words:
            (x, s), (y, t) = words[a], words[b]
            if a < b and x and y:
                score = 0.7 * len(x & y) / len(x | y) + 0.3 * 2 * len(grams(s) & grams(t)) / (len(grams(s)) + len(grams(t)))
                if score >= 0.95 and len(x) >= 6 or rows[a][3] == rows[b][3] and score >= 0.86 and len(x) >= 5:
                    want.add((a, b))
    assert set(got) == want and want


def test_trigrams_of_any_characters(spark):
    cases = ["", "a", "ab", "abc", "abcabc", "é😀x😀é", "ab  c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in cases], "t string").select(text.trigrams(F.col("t"))).collect()]
    want = [([t] if t else []) if len(t) < 3 else list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) for t in cases]
    assert got == want


def test_candidates_are_bounded_before_texts_are_read_and_no_link_is_lost(spark):
    """Pairs of all documents of a small table by every rule, against brute force over the same candidates; words of any frequency, and with no word left out where texts are read."""
    kinds = ["PROPERTY_CODE:A1", "MAPS_URL:m", "EMAIL:a@b.co"]
    rows = []
    for i in range(240):
        words = [f"w{k}" for k in range(12)] + [f"g{i // 6}x{k}" for k in range(4 + i % 3 * 10)] + [f"own{i}"] * (i % 4)
        rows.append((i, f"h{i // 12}" if i % 5 == 0 else f"h-{i}", f"u{i // 3}" if i % 2 else "", f"a{i % 7}", " ".join(words), [k for n, k in enumerate(kinds) if (i // 6 + n) % 4 < 2]))
    items = spark.createDataFrame(rows, "id long, content_hash string, url string, author string, norm string, identifiers array<string>").withColumn("tokens", text.tokens(F.col("norm")))
    from fieldmill.operators.dedupe import capped
    from fieldmill.operators.shaping import star_pairs

    side = lambda x: items.select(*[F.col(c).alias(f"{c}_{x}") for c in items.columns])
    j = star_pairs(capped(R.signals(items), len(rows))).join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    s = text.similarity(F.col("tokens_a"), F.col("tokens_b"), text.trigrams(F.col("norm_a")), text.trigrams(F.col("norm_b")))
    same = lambda c: (F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != "")
    r = R.decision(s, F.size("tokens_a"), F.length("norm_a"), same("content_hash"), same("url"), same("norm"), same("author"), F.array_intersect("identifiers_a", "identifiers_b"))
    want = {(x["a"], x["b"], x["r"]["method"], round(x["r"]["confidence"], 9)) for x in j.select("a", "b", r.alias("r")).where("r IS NOT NULL").collect()}
    assert len({m for _, _, m, _ in want}) >= 4
    got = {(x["a"], x["b"], x["method"], round(x["confidence"], 9)) for x in R.repost_pairs(items).collect()}
    assert got == want
    rows_ = items.withColumn("brief", R._brief())
    found = {frequent: {tuple(x) for x in R.candidate_pairs(rows_, frequent=frequent).collect()} for frequent in (1, 100)}
    assert found[1] == found[100] and {x[:2] for x in found[1]} >= {x[:2] for x in want}
    apart = spark.createDataFrame([(1000 + i, "", "", f"z{i}", " ".join([f"v{k}" for k in range(40)] + [f"o{i}x{k}" for k in range(20)]), None) for i in range(30)], items.drop("tokens").schema)
    rows_ = apart.withColumn("tokens", text.tokens(F.col("norm"))).withColumn("identifiers", F.array().cast("array<string>")).withColumn("brief", R._brief())
    sketches = {x["id"]: x["sketch"] for x in R._sketches(rows_).collect()}
    assert sum(abs(p - q) for p, q in zip(sketches[1000], sketches[1001])) <= 40 and sum(sketches[1000]) == 60


def test_only_sizes_of_arrays_are_kept_between_steps(spark, monkeypatch):
    kept, cut = [], R._cut
    monkeypatch.setattr(R, "_cut", lambda df: kept.append(df.schema.simpleString()) or cut(df))
    items = spark.createDataFrame([(i, f"h{i}", "", "ann", f"villa number {i % 2} near the river with a garden", None) for i in range(4)], "id long, content_hash string, url string, author string, norm string, identifiers array<string>").withColumn("tokens", text.tokens(F.col("norm")))
    assert R.repost_pairs(items).count() == 2
    assert len(kept) == 4 and not any("norm" in x or "grams_a" in x for x in kept)  # texts and trigrams of both sides were stored before
