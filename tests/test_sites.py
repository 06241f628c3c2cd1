"""Near duplicates, crawl order, claims, overrides and stateful streams on small tables, against plain loops."""

import hashlib
import random
import time
from collections import deque
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import simhash
from pagewright.operators import claims, crawl, overrides
from pagewright.operators import near_duplicates as near
from pagewright.streaming import blocks, index


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.fixture(scope="module")
def prints(spark):
    """Chains, clusters, copies, two sites and a null one; ids out of order."""
    rnd, rows = random.Random(5), []
    for site in ("a", "b", None):
        base = [rnd.getrandbits(64) for _ in range(6)]
        for h in base:
            for step in range(12):
                h ^= sum(1 << rnd.randrange(64) for _ in range(3)) & (2**64 - 1)
                rows += [(site, simhash.signed(h))] * rnd.choice([1, 1, 3])
    ids = rnd.sample(range(10_000), len(rows))
    rows = [(s, i, h) for (s, h), i in zip(rows, ids, strict=True)] + [("c", 1, 0)]
    return near.written(spark.createDataFrame(rows, "site string, id long, simhash long"), "prints"), rows


@pytest.mark.parametrize("cell", [near.CELL, 2])
def test_near_pairs_equal_a_double_loop(prints, cell):
    df, rows = prints
    first = {}
    for s, i, h in rows:
        first[s, h] = min(i, first.get((s, h), i))
    own = sorted((str(s), i, h) for (s, h), i in first.items())
    want = sorted((a[0], a[1], b[1], apart(a[2], b[2])) for n, a in enumerate(own) for b in own[n + 1 :] if a[0] == b[0] and apart(a[2], b[2]) <= 12)
    got = sorted((str(r["site"]), r["a"], r["b"], r["distance"]) for r in near.near_pairs(near.classes(df), cell=cell).collect())
    assert got == want and len(want) > 300
    assert near.near_duplicate_members(df).count() == len(rows)


def shuffled(spark):
    """Bytes that all shuffles of the session wrote so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.5)  # for the status store
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_near_pairs_copy_a_row_a_few_times_only(spark):
    """4,000 different texts of a site, many within reach: no row goes under each of 13 blocks or to each of 100 cells."""
    rnd, rows = random.Random(3), {}
    while len(rows) < 4_000:
        rows[sum(1 << i for i in range(64) if rnd.random() < 0.2)] = len(rows)
    df = near.written(spark.createDataFrame([("a", i, simhash.signed(h)) for h, i in rows.items()] + [("a", None, 5)], "site string, first long, simhash long"), "prints")
    before = shuffled(spark)
    pairs = near.near_pairs(df, cell=40)
    pairs.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 4_000 * 10 * 60
    order = list(rows)
    want = sum(apart(a, b) <= 12 for n, a in enumerate(order) for b in order[:n])
    assert pairs.count() == pairs.where("a < b and distance <= 12").count() == want > 10_000


def test_dedup_greedy_equals_the_scan(prints):
    df, rows = prints
    held, want = {}, []
    for s, i, h in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        kept = all(apart(h, k) > 12 for k in held.setdefault(s, []))
        held[s] += [h] * kept
        want.append((str(s), i, kept))
    assert sorted((str(r["site"]), r["id"], r["kept"]) for r in near.dedup_greedy(df).collect()) == sorted(want)


def test_dedup_greedy_of_a_chain(spark):
    """a near b, b near c, a far from c: b goes with a, so c stays; of equal fingerprints the first row stays."""
    rows = [("s", 1, 0), ("s", 2, (1 << 12) - 1), ("s", 3, (1 << 24) - 1), ("s", 4, (1 << 24) - 1), ("s", 5, (1 << 36) - 1)]
    got = near.dedup_greedy(spark.createDataFrame(rows, "site string, id long, simhash long")).orderBy("id")
    assert [r["kept"] for r in got.collect()] == [True, False, True, False, False]
    none = near.dedup_greedy(got.select("site", "id", F.lit(0).cast("bigint").alias("simhash")).where("false"))
    assert none.count() == 0


def test_fingerprints_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "?!"), (4, "one two two"), (5, "two two one"), (6, "w " * 70_000 + "x")]
    got = {r["id"]: r["simhash"] for r in near.fingerprints(spark.createDataFrame([("s", i, t) for i, t in texts], "site string, id long, text string")).collect()}
    assert set(got) == {3, 4, 5, 6} and got[3] == 0 and got[4] == got[5]
    assert got[6] == spark.range(1).select(F.element_at(simhash.word_hashes(F.lit("w")), 1).alias("h")).first()["h"]


def test_unique_ratio(spark):
    rows = [("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("s", 4, (1 << 40) - 1), ("t", 1, 0)]
    got = near.unique_content_ratio(spark.createDataFrame(rows, "site string, id long, simhash long")).orderBy("site")
    assert [tuple(r) for r in got.collect()] == [("s", 4, 2, 50.0), ("t", 1, 1, 100.0)]


@pytest.mark.parametrize(("depth", "pages"), [(5, 400), (2, 400), (5, 7), (5, 1)])
def test_crawl_order_equals_a_queue(spark, depth, pages):
    rnd = random.Random(9)
    edges = {(s, f"p{rnd.randrange(25)}", f"p{rnd.randrange(25)}"): rnd.randrange(6) for s in "st" for _ in range(70)}
    rows = [(s, a, b, p) for (s, a, b), p in edges.items() if a != b] + [("u", "x", "y", 0)]
    starts = [("s", "p1"), ("s", "p2"), ("t", "p3"), ("v", "alone"), ("u", None)]
    want = []
    for site, start in (("s", "p1"), ("t", "p3"), ("v", "alone")):
        seen, queue = {start: (0, 1)}, deque([start])
        while queue:
            page = queue.popleft()
            for _, _, to, _ in sorted((r for r in rows if r[:2] == (site, page)), key=lambda r: (r[3], r[2])):
                if to not in seen and len(seen) < pages and seen[page][0] < depth:
                    seen[to] = (seen[page][0] + 1, len(seen) + 1)
                    queue.append(to)
        want += [(site, url, *at) for url, at in seen.items()]
    got = crawl.crawl_order(spark.createDataFrame(rows, "site string, src string, dst string, pos int"), spark.createDataFrame(starts, "site string, url string"), depth, pages)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_truth_table(spark):
    page = [("s", "u1", "Acme", ""), ("s", "u2", "Acme", "Best"), ("s", "u2", "Acme", "Best"), ("s", "u3", "Zeta", "Rest"), ("t", "u4", None, "")]
    flags = spark.createDataFrame([(*p, "call 555-123-4567 or me@site.org") for p in page], "site string, url string, title string, description string, footer_text string")
    made = claims.profile_claims(flags).unionByName(claims.claims(flags.where("site = 's'").limit(1), "Business", "Services", "Roofs", F.lit("Roofs"), 0.9, "service"))
    made = made.unionByName(claims.claims(flags.where("site = 't'"), "Business", "Services", "Walls", F.lit("Walls"), 0.5, "service"))
    truth = claims.truth_table(made)
    rows = {(r["site"], r["field"], r["value"]): r for r in truth.collect()}
    acme, zeta = rows["s", "Name", "Acme"], rows["s", "Name", "Zeta"]
    assert (acme["mentions"], acme["sources"], acme["first_sources"], acme["chosen"], zeta["chosen"]) == (3, 2, "u1 u2", True, False)
    assert rows["s", "Tagline", "Best"]["chosen"] and not rows["s", "Tagline", "Rest"]["chosen"]  # more mentions on as many pages
    assert rows["t", "Email", "me@site.org"]["chosen"] and rows["s", "Roofs", "Roofs"]["chosen"]
    assert [r["field"] for r in claims.filter_by_confidence(truth, "high").collect()] == ["Roofs"]
    assert [r["field"] for r in claims.filter_by_confidence(truth, "low", "wal").collect()] == ["Walls"]
    summary = {r["site"]: r for r in claims.confidence_summary(truth).collect()}
    assert (summary["s"]["total"], summary["s"]["high"], summary["s"]["medium"], summary["s"]["low"], summary["s"]["contradicted"]) == (7, 1, 6, 0, 2)
    assert summary["t"]["low"] == 1 and summary["t"]["average"] == 0.7


def test_overrides_as_of_the_run(spark):
    day = lambda n: datetime(2024, 1, n)
    pages = spark.createDataFrame([(1, "generic", day(10)), (1, "generic", day(3)), (2, "article", day(10)), (3, "landing", day(10)), (None, "contact", day(10))], "page_id long, page_type string, run_at timestamp")
    sets = [(1, "article", day(2), 1), (1, "product", day(4), 1), (1, "catalog", day(4), 2), (1, "contact", day(11), 1), (2, "homepage", day(1), 1), (3, "utility", day(10), None), (3, "contact", day(10), None), (None, "article", day(1), 1)]
    got = overrides.override_page_type(pages, spark.createDataFrame(sets, "page_id long, page_type string, set_at timestamp, seq int")).collect()
    assert sorted((str(r["page_id"]), r["inferred_type"], r["page_type"], r["overridden"]) for r in got) == [
        ("1", "generic", "article", True), ("1", "generic", "catalog", True), ("2", "article", "article", False), ("3", "landing", "contact", True), ("None", "contact", "contact", False)
    ]


INDEX_ROW = "run string, page_id long, ts timestamp, seq long, title string, path string, url string, status int, words long, media long, load_time_ms long, content_length_bytes long, page_type string"


def test_page_index_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Shuffled, repeated and late arrivals in five files, three before and two after a restart from the checkpoint."""
    rnd, at = random.Random(2), datetime(2024, 1, 1)
    rows = [("r" + str(p % 2), p, at + timedelta(minutes=rnd.randrange(500)), n, f"t{n}", None, f"u{p}", 200 + n, None, n, n, n, rnd.choice([None, "article"])) for n, p in enumerate([*range(20)] * 4)]
    rows += [("r0", None, at, 0, *[None] * 9)]
    sent = rows + rnd.sample(rows, 20)
    rnd.shuffle(sent)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.schema(INDEX_ROW).option("maxFilesPerTrigger", 1).parquet(source)
        q = index.page_index_stream(stream).writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True)
        q.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()

    for n in range(5):
        spark.createDataFrame(sent[n::5], INDEX_ROW).coalesce(1).write.mode("append").parquet(source)
        if n in (2, 4):
            run()
    got = index.index_view(spark.read.parquet(out).drop("batch"))
    want = index.index_view(index.page_index_stream(spark.createDataFrame(rows, INDEX_ROW)))
    canon = lambda df: sorted(map(str, df.collect()))
    assert canon(got) == canon(want)
    by_page = {r["page_id"]: r for r in want.collect()}
    for p in range(20):
        mine = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2], r[3]))
        assert (by_page[p]["title"], by_page[p]["page_type"]) == (mine[-1][4], mine[-1][12])
    once = index.index_view(index.page_index_stream(spark.createDataFrame(rows[:1], INDEX_ROW).withColumn("page_type", F.lit(None).cast("string")))).first()
    assert (once["path"], once["words"], once["page_type"], once["position"]) == ("/", 0, "generic", 1)


def test_active_blocks_equal_a_loop(spark):
    rnd, at = random.Random(8), datetime(2024, 1, 1)
    rows = [(s, i, at + timedelta(seconds=rnd.randrange(30_000)), "/") for i in range(300) for s in [rnd.randrange(3)]] + [(0, 999, at, "/"), (0, 998, at, "/")]
    got = blocks.active_blocks(spark.createDataFrame(rows, "site long, event_id long, ts timestamp, url string")).collect()
    want = sorted((s, i, sum(a == s and timedelta(0) <= t - b <= timedelta(seconds=blocks.TTL) for a, _, b, _ in rows)) for s, i, t, _ in rows)
    assert sorted((r["site"], r["event_id"], r["active"]) for r in got) == want


def test_block_board_expires_without_new_events(spark, tmp_path):
    """A site's blocks go when the watermark, moved by another site, passes their time."""
    kind, at, source, rows = "site long, event_id long, ts timestamp, url string", datetime(2024, 1, 1), str(tmp_path / "in"), []
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = [[(1, 1, at, "/a"), (1, 2, at + timedelta(minutes=20), "/b"), (1, 2, at + timedelta(minutes=20), "/b")], [(2, 3, at + timedelta(minutes=75), "/c")], [(2, 4, at + timedelta(minutes=180), "/d")], [(2, 5, at + timedelta(minutes=181), "/e")]]
        for batch in batches:
            spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
            q = blocks.block_board(spark.readStream.schema(kind).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
            q.foreachBatch(lambda df, _: rows.extend(tuple(r) for r in df.collect())).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    one = [(a, n, ids) for s, a, n, ids in rows if s == 1]
    assert one == [(at + timedelta(minutes=20), 2, "2,1"), (at + timedelta(minutes=60), 1, "2"), (at + timedelta(minutes=80), 0, "")]


@pytest.mark.parametrize("head", [1, 2, 7])
def test_dedup_greedy_in_short_heads_equals_the_scan(prints, head):
    df, rows = prints
    held, want = {}, []
    for s, i, h in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        kept = all(apart(h, k) > 12 for k in held.setdefault(s, []))
        held[s] += [h] * kept
        want.append((str(s), i, kept))
    assert sorted((str(r["site"]), r["id"], r["kept"]) for r in near.dedup_greedy(df, head=head).collect()) == sorted(want)


def test_dedup_greedy_makes_no_pairs_among_all_texts_in_reach(spark, monkeypatch):
    """400 texts, all in reach of the first: it drops them before they meet each other."""
    made, keep = [], near.written
    monkeypatch.setattr(near, "written", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    rows = [("s", i, (1 << i % 6) | (1 << (6 + i // 6 % 6)) | i << 12) for i in range(1, 400)] + [("s", 0, 0)]
    got = near.dedup_greedy(spark.createDataFrame(rows, "site string, id long, simhash long"), within=12, head=20)
    assert [r["id"] for r in got.where("kept").collect()] == [0]
    assert sum(df.count() for name, df in made if name == "undecided") < 400


def test_fingerprints_equal_the_column_expression(spark):
    """Texts beyond one slice, with empty and odd ones among them, with words of any script."""
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice(["a", "Été", "тест", "b_1", "日本", "x" * 40, "", "--"]) + str(rnd.randrange(50)) * rnd.randrange(2) for _ in range(rnd.randrange(1, 60)))) for i in range(2500)] + [(3000, "?!"), (3001, "w " * 70_000)]
    df = spark.createDataFrame([("s" if i % 3 else None, i, t) for i, t in texts], "site string, id long, text string").coalesce(1)
    want = {r["id"]: r["h"] for r in df.where("text <> ''").select("id", simhash.majority_bits(simhash.word_hashes(F.col("text"))).alias("h")).collect()}
    assert {r["id"]: r["simhash"] for r in near.fingerprints(df).collect()} == want and len(set(want.values())) > 2000
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([["a", "a", "b"], []], pa.list_(pa.string()))], ["id", "words"])
    assert [b.to_pydict() for b in simhash.simhash_of_words(iter([batch, batch.slice(2)]))] == [{"id": [1, 2], "simhash": [simhash.signed(int.from_bytes(hashlib.md5(b"a").digest()[8:])), 0]}]
