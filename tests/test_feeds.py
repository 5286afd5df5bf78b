import json
import re
import time

import ahocorasick
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldmill.functions import gazetteer as G
from fieldmill.sources import feeds


def slow(names, text):
    """Every name at every place."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = []
    for n in names:
        for m in re.finditer(f"(?={re.escape(n)})", low):
            i, j = m.start(), m.start() + len(n)
            if not low[max(i - 1, 0) : i].isalnum() and not low[j : j + 1].isalnum():
                out.append((i, j, n))
    return sorted(out)


WORDS = st.lists(st.sampled_from(["wat", "Bo", "bo", "wat bo", "é", "ébo", " ", ", ", "-", "1", "ស", "İ"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_matches_equal_a_search_at_every_place(text):
    names = ["wat", "bo", "wat bo", "é", "bo-bo", "ស", "1"]
    automaton = ahocorasick.Automaton()
    for n in names:
        automaton.add_word(n, n)
    automaton.make_automaton()
    assert sorted(G.matches(automaton, text)) == slow(names, text)


def test_names_of_several_automata_keys_that_share_a_name_and_places(spark):
    names = spark.createDataFrame([("a", "Wat Bo"), ("b", "wat bo"), ("c", "bo"), ("d", None), ("e", ""), ("f", "river"), ("g", "old river road")], "key string, name string")
    texts = spark.createDataFrame([(1, "Near WAT BO, bo!"), (2, "Old river road"), (3, None), (4, ""), (5, "wat bobo " * 1000 + "Bo"), (1, "bo")], "id long, text string")
    want = [(1, "a", 5, 11), (1, "b", 5, 11), (1, "c", 0, 2), (1, "c", 13, 15), (1, "c", 9, 11), (2, "f", 4, 9), (2, "g", 0, 14), (5, "c", 9000, 9002)]
    for most in (1 << 20, 5):
        assert sorted((tuple(r) for r in G.find_names(texts, "id", "text", names, most_bytes=most).collect()), key=str) == want
    found = G.find_names(texts, "id", "text", names)
    assert sorted(tuple(r) for r in G.without_nested(found, "id").where("id = 2").collect()) == [(2, "g", 0, 14)]
    places = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("f", "y"), ("g", "z")], "key string, place string")
    assert sorted(tuple(r) for r in G.named_place(found, "id", places).collect()) == [(1, "a", "x", 1), (2, "g", None, 2), (5, "c", "x", 1)]
    assert G.find_names(texts, "id", "text", names.limit(0)).count() == 0


def post(folder, source, file, *items):
    at = folder / source
    at.mkdir(parents=True, exist_ok=True)
    with (at / file).open("a") as f:
        f.writelines((i if isinstance(i, str) else json.dumps({"external_id": str(i), "text": f"t{i}", "more": 1})) + "\n" for i in items)


def read(rows):
    return sorted((r["source"], r["external_id"]) for r in rows.collect())


def test_batch_read_leaves_out_what_is_no_item(spark, tmp_path):
    post(tmp_path, "source=a", "1.json", 1, 2, "no json", "[3]", '{"text": "no id"}')
    post(tmp_path, "source=a", "2.json", 4)
    post(tmp_path, "b", "1.json", 5)
    feeds.register(spark)
    rows = spark.read.format(feeds.NAME).option("path", str(tmp_path)).load()
    assert read(rows) == [("a", "1"), ("a", "2"), ("a", "4"), ("b", "5")] and rows.rdd.getNumPartitions() == 3


def test_the_cursor_goes_round_and_reads_only_what_is_new(tmp_path):
    root = tmp_path / "in"
    for s in "abcde":
        post(root, s, "1.json", 1)
    stream = feeds.FeedStream(feeds.JsonLines(str(tmp_path / "in")), ["external_id"], 2, str(tmp_path / "cursor"))
    start, seen = stream.initialOffset(), []
    for _ in range(4):
        end = stream.latestOffset()
        seen.append([p.source for p in stream.partitions(start, end)])
        stream.commit(start)
        start = end
    assert seen == [["a", "b"], ["c", "d"], ["e"], []] and start["cursor"] == 1
    post(root, "d", "2.json", 2, 3)
    post(root, "e", "1.json", 2)
    # The last offset that was finished is one visit behind the last one that was given out.
    again = feeds.FeedStream(feeds.JsonLines(str(root)), ["external_id"], 2, str(tmp_path / "cursor"))
    got = []
    for _ in range(3):
        end = again.latestOffset()
        got += [(p.source, p.begin > 0) for p in again.partitions(start, end)]
        start = end
    assert sorted(got) == [("d", True), ("e", True)] and len(list((tmp_path / "cursor").iterdir())) == 2


def test_stream_read_with_a_restart_equals_a_plain_read(spark, tmp_path):
    feeds.register(spark)
    root, ids = tmp_path / "in", iter(range(1000))
    for s in "abcdefg":
        post(root, s, "1.json", *[next(ids) for _ in range(5)])

    def run(least):
        rows = spark.readStream.format(feeds.NAME).option("path", str(root)).option("sources_per_batch", "3").option("cursor", str(tmp_path / "cursor")).load()
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        ends = time.time() + 60
        while time.time() < ends and q.isActive:
            try:
                if spark.read.schema(feeds.SCHEMA).parquet(f"{tmp_path}/out").count() >= least:
                    break
            except Exception:
                pass
            time.sleep(0.5)
        q.stop()
        return read(spark.read.schema(feeds.SCHEMA).parquet(f"{tmp_path}/out"))

    assert len(run(35)) == 35
    for s in "cax":
        post(root, s, "2.json", *[next(ids) for _ in range(2)])
    after = run(41)
    assert len(after) == 41 and after == read(spark.read.format(feeds.NAME).option("path", str(root)).load())


def test_guarded_lines_keep_the_first_of_each_key(spark, tmp_path):
    from fieldmill.sources.readers import guarded_lines

    (tmp_path / "b.txt").write_text('{"id": "1", "v": "later file"}\n{"id": "4", "v": "x"}')
    (tmp_path / "a.txt").write_text('for (;;);{"id": "1", "v": "z first"}\r\n{"id": "1", "v": "a second"}\nnothing\n[1]\n)]}\'{"id": "2", "v": null}\n{"id": null, "v": "none"}\n\n{"id": "3", "_file": 1}')
    got = guarded_lines(spark, str(tmp_path), "id string, v string", "id")
    assert got.columns == ["id", "v"] and sorted((tuple(r) for r in got.collect()), key=str) == [("1", "z first"), ("2", None), ("3", None), ("4", "x")]
