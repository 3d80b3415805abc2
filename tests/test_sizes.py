"""What only larger tables or odd rows showed."""

import duckdb
import numpy as np

from ledgerlight.functions import crypto, names
from ledgerlight.llm import graph, ngram_join
from ledgerlight.llm.store import Scratch
from ledgerlight.operators import anomaly, profile, screening
from ledgerlight.plans.engine import RuleSet
from ledgerlight.plans.library import Rule
from ledgerlight.plans.queries import ORACLE, QUERIES


def _usds(spark, usds):
    return spark.createDataFrame([("o", i, v) for i, v in enumerate(usds)], "org_id string, us long, usd double")


def test_zeros_of_a_table_are_values(spark):
    cells = profile.long_form(_usds(spark, [0.0, 2.0, 4.0, None]), [], ["usd"], zeros=True)
    for found in (profile.profile(cells), profile.published(profile.partial(cells))):
        r = found.first()
        assert (r["seen"], r["filled"], r["min"], r["mean"], r["first_us"]) == (4, 3, 0.0, 2.0, 0)


def test_zeros_are_blank_where_missing_ones_are_zero(spark):
    r = profile.profile(profile.long_form(_usds(spark, [0.0, 2.0, 4.0, None]), [], ["usd"])).first()
    assert (r["seen"], r["filled"], r["min"], r["mean"], r["first_us"]) == (4, 2, 2.0, 3.0, 1)


def test_octets_compare_as_duckdb():
    rng = np.random.default_rng(3)
    words = ["ththouwh", "ththheou", *{"".join(rng.choice(list("abcß"), rng.integers(1, 9))) for _ in range(60)}]
    pairs = [(a, b) for a in words for b in words]
    con = duckdb.connect()
    con.execute("create table p(i int, a text, b text)")
    con.executemany("insert into p values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    wanted = [r[0] for r in con.execute("select jaro_similarity(a, b) from p order by i").fetchall()]
    assert [names.jaro(a, b, True) for a, b in pairs] == wanted
    assert names.jaro("ththouwh", "ththheou") < names.jaro("ththouwh", "ththheou", True)
    # three equal first letters add three tenths of the rest, not a double beside it
    assert names.similar("abcx", "abcy", True) == names.jaro("abcx", "abcy", True) + 0.3 * (1 - names.jaro("abcx", "abcy", True))


def test_list_index_equals_comparing_all():
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdß"), rng.integers(1, 9)))
    people = [" ".join(word() for _ in range(rng.integers(1, 4))) for _ in range(160)]
    index = screening.ListIndex([[(n, "", True)] for n in people[:80]])
    found = 0
    for q in people[80:]:
        at, _, scores, _ = index.search(q, 0.01)
        wanted = {i: names.similarity(q, n) for i, n in enumerate(people[:80]) if names.similarity(q, n) > 0}
        assert set(at.tolist()) == set(wanted) and all(abs(wanted[i] - s) < 1e-12 for i, s in zip(at.tolist(), scores))
        found += len(wanted)
    assert found > 40


def test_trials_have_the_places_of_their_sql(spark, tmp_path):
    con = duckdb.connect()
    # prices that halve a hundredth of a million, many rows of one place in the order but for their key
    con.execute("create table orders as select i as o_orderkey, i % 9 as o_custkey, 'O' as o_orderstatus, (i % 50) * 10000.0 + 5000 as o_totalprice from range(4000) r(i)")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    wanted = con.execute(ORACLE["trials_ranked"]).fetchall()
    assert sorted(map(tuple, QUERIES["trials_ranked"](spark, str(tmp_path)).collect())) == sorted(wanted)


def test_places_do_not_hang_on_partitions(spark):
    rows = [(i, i % 7 / 2, float(i % 3), i % 2, "warming" if i % 11 == 0 else None) for i in range(300)]
    trials = spark.createDataFrame(rows, "trial long, separation double, drift double, nodes long, refused string").repartition(9)
    found = {r["trial"]: r["place"] for r in anomaly.placed(trials).collect()}
    order = sorted((r for r in rows if r[4] is None), key=lambda r: (-r[1], r[2], r[3], r[0]))
    assert found == {r[0]: i + 1 for i, r in enumerate(order)}


def test_users_of_a_device_are_counted_without_collecting_them(spark):
    rng, day = np.random.default_rng(2), 86_400_000_000
    rows = [("o", str(i), int(rng.integers(0, 60)) * day // 2, str(rng.choice(["a", "b", "c", "d", "", "e"])), str(rng.choice(["x", "y", ""])), 1.0) for i in range(250)]
    tx = spark.createDataFrame([(*r[:3], None if i % 29 == 0 else r[3], *r[4:]) for i, r in enumerate(rows)], "org_id string, tx_id string, us long, user string, device string, usd double")
    rs = RuleSet([Rule(f"n{n}", f'Distinct("device", "user", "7d") > {n}') for n in range(5)])
    prepared = rs.prepare(tx)
    plan = prepared._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    got = {r["tx_id"]: r["_distinct_device_user_" + str(7 * day)] for r in prepared.collect()}
    held = tx.collect()
    for r in held:
        same = [o for o in held if o["device"] == r["device"] != "" or o["tx_id"] == r["tx_id"]]
        assert got[r["tx_id"]] == len({o["user"] for o in same if r["us"] - 7 * day <= o["us"] <= r["us"] and o["user"]})


def test_profile_of_batches_keeps_small_deviations(spark):
    # a thousand million has a square that leaves no digit for what is between these numbers
    cells = profile.long_form(_usds(spark, [1e9 + i % 5 for i in range(200)]), [], ["usd"], zeros=True)
    found = profile.published(profile.partial(cells.where("us < 150")).unionByName(profile.partial(cells.where("us >= 150")))).first()
    assert abs(found["deviation"] - 2**0.5) < 1e-6 and found["mean"] == 1e9 + 2 and found["seen"] == 200
    assert found["sketch"] == profile.sketch(cells).first()["sketch"]


def test_streamed_profile_has_rows_without_an_instant(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table events as select i as event_id, case when i % 10 > 0 then timestamp '2024-01-01' + to_milliseconds(i) end as ts, i % 7 as user_id, 'view' as event_type, i * 1.5 as value, '{\"k\": 3}' as props from range(60) r(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    wanted = con.execute(ORACLE["field_profile_streamed"]).fetchall()
    assert sorted(map(tuple, QUERIES["field_profile_streamed"](spark, str(tmp_path)).collect())) == sorted(wanted)


def test_hashes_of_many_are_those_of_each():
    texts = [b"", b"a", b"\xff\0\x80", *(bytes([i % 256]) * (i % 90) for i in range(300)), b"long" * 3000]
    assert crypto.fnv1a_many(texts).tolist() == crypto.fnv1a_many(texts, 0).tolist() == [crypto.fnv1a(t) for t in texts]


def test_few_edges_take_few_tasks(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 10 < 9], "a long, b long")
        found = graph.components(edges, Scratch(spark, "few"), "c")
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {(r["node"], r["component"]) for r in found.collect()} == {(i, i // 10 * 10) for i in range(300) if i % 10}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_many_candidates_of_a_block_are_those_of_comparing_all():
    rng = np.random.default_rng(5)
    whole = np.sort(rng.choice(1 << 40, 300, False)).astype(np.uint64)
    sets = [np.unique(np.r_[np.delete(whole, rng.integers(0, 300, k)), rng.choice(1 << 40, k).astype(np.uint64)]) for k in rng.integers(0, 30, 90)] + [whole[:0], whole[:40]]
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    wanted = {q: {d for d in range(len(sets)) if d != q and len(sets[q]) and similar(sets[q], sets[d])} for q in range(len(sets))}
    found = {q: set(d) for q, d in ngram_join.similar_in_block(sets, list(range(len(sets))), 90, 100)}
    assert all(found.get(q, set()) == d for q, d in wanted.items()) and max(map(len, wanted.values())) > 16


def test_words_met_many_at_a_time():
    rng = np.random.default_rng(13)
    words = sorted({"".join(rng.choice(list("abcdß"), rng.integers(1, 12))) for _ in range(300)} | {"x" * 64, "x" * 65, "xy" * 32})
    for octets in (False, True):
        for listed in (words[:200], words):  # the second has words that are too long for bits
            index = screening.ListIndex([[(w, "", True)] for w in listed], octets)
            index.meet(words)
            for w in words:
                ids, there, back, forms = index.near[w]
                at = {index.words[i]: (a, b) for i, a, b in zip(ids.tolist(), there.tolist(), back.tolist())}
                floor = names.PART_FLOOR
                folded = [x for x in index.words if max(names.similar(w, x, octets), names.similar(x, w, octets)) >= floor]
                assert at == {x: (names.similar(w, x, octets), names.similar(x, w, octets)) for x in folded} and len(forms) == len(ids)
