"""What grows with the data grows no faster than it: rows that a plan makes, on frames where many rows are alike."""

import math
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa

from patternmill.operators import facts, nulls, retrieval
from patternmill.streaming import history


def most_rows(df):
    """The rows that the busiest operator of df's plan made; df is run."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from walk(node.executedPlan())
        elif "QueryStage" in name:
            yield from walk(node.plan())
        else:
            made = node.metrics().get("numOutputRows")
            if made.isDefined():
                yield made.get().value()
            for i in range(node.children().size()):
                yield from walk(node.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def cards_and_questions(spark):
    cards = [(c, t, w) for c in range(600) for t, w in (("all", 1.0), ("ab"[c % 2], 0.5))] + [(c, "all", 0.25) for c in range(40)]
    words = [(q, t) for q in range(200) for t in ("all", "ab"[q % 2], "unheard")] + [(999, "unheard"), (None, "all")]
    names = [(c, "ab"[c % 3 % 2]) for c in range(0, 700, 7)]
    return cards, words, names, [spark.createDataFrame(*x) for x in ((cards, "card long, tok string, w double"), (words, "q long, tok string"), (names, "card long, name string"))]


def plain_cards(cards, words, names, top=5):
    held, named, out = {}, {}, []
    for c, t, w in cards:
        held.setdefault(c, {})[t] = max(w, held.get(c, {}).get(t, 0))
    for c, n in names:
        named.setdefault(c, set()).add(n)
    for q in {q for q, _ in words if q is not None}:
        idf = {t: math.log2(1 + len(held) / (sum(t in h for h in held.values()) or 1)) for t in {t for x, t in words if x == q}}
        rows = []
        for c in held.keys() | named.keys():
            s, pins = sum(w * idf.get(t, 0) for t, w in held.get(c, {}).items()) / sum(idf.values()), len(named.get(c, set()) & idf.keys())
            score = round(min(1.0, 1.0 if pins / len(idf) >= 0.5 else s + 0.25 if pins else s), 6)
            rows += [(-score, pins == 0, c)] if score > 0 else []
        out += [(q, c, -s, not free, -s < 0.34, k + 1) for k, (s, free, c) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_cards_and_questions_that_are_alike_meet_once(spark):
    cards, words, names, (c, w, n) = cards_and_questions(spark)
    for names_of, given in ((names, n), ([], None)):
        out = retrieval.rank_cards(c, w, given)
        assert most_rows(out) < 5000, "600 cards times 200 questions would be 120,000 rows"
        assert sorted(map(tuple, out.collect())) == plain_cards(cards, words, names_of)


def test_changes_that_say_the_same_meet_a_question_once(spark):
    rows = [(s, s // 3, t) for s in range(600) for t in ("all", "abc"[s % 3])] + [(7, 2, "c"), (7, 900, "all")]
    words = [(q, t) for q in range(200) for t in ("all", "abc"[q % 2], "unheard")[: 1 + q % 3]] + [(999, "unheard")]
    out = retrieval.rank_changes(spark.createDataFrame(rows, "sha long, ts long, tok string"), spark.createDataFrame(words, "q long, tok string"))
    assert most_rows(out) < 5000, "600 changes times 200 questions would be 120,000 rows"
    held, want, size = {}, [], len({s for s, _, _ in rows})
    for s, ts, t in rows:
        held.setdefault((s, ts), set()).add(t)
    for q in {q for q, _ in words}:
        idf = {t: math.log2(1 + size / (len({s for s, _, x in rows if x == t}) or 1)) for t in {t for x, t in words if x == q}}
        found = [(-round(sum(idf.get(t, 0) for t in h) / sum(idf.values()), 6), -ts, s) for (s, ts), h in held.items()]
        want += [(q, s, -score, k + 1) for k, (score, _, s) in enumerate(sorted(x for x in found if x[0] <= -0.34)[:5])]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_a_large_block_trades_in_passes_over_its_items(spark):
    rng = np.random.default_rng(1)
    held = np.unique(np.stack([rng.integers(0, 200_000, 600_000), rng.integers(0, 6, 600_000)]), axis=1)
    began = time.process_time()
    row = nulls.trade(held[0], held[1], 200_001, np.random.default_rng(2), 10)
    assert time.process_time() - began < 20, "a million trades one by one take longer"
    assert (np.bincount(row) == np.bincount(held[0])).all() and len(np.unique(row * 6 + held[1])) == len(row)
    small = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)]
    mixed = {tuple(sorted(zip(nulls.trade(np.array([r for r, _ in small]), np.array([u for _, u in small]), 3, np.random.default_rng(k), 30), [u for _, u in small]))) for k in range(200)}
    # all tables of sizes 2, 2, 1 in which unit 1 is held twice and units 0, 2 and 3 once
    assert len(mixed) == 12


def test_first_touches_are_not_sorted_and_tasks_get_so_many_rows(spark, sf_dir):
    from patternmill import catalog
    from patternmill.sources import tables

    plan = catalog.queries()["birth_obligations"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan
    assert [tables.pieces(spark.range(n), 10) for n in (0, 10, 11, 95)] == [1, 1, 2, 10]


def test_scopes_that_are_alike_are_governed_once(spark):
    kind = "scope long, kind string, role string, ambiguous boolean, dirs array<string>, w double, survived boolean, pid string, v string"
    rows = [(i, "file", "hv"[i % 2], i % 11 == 0, ["s", f"s/{i % 3}"], 1.0, i % 50 > 0, f"has:{p}", "true" if f else "false")
            for i in range(400) for p, f in (("a", i % 2 or i > 392), ("b", i % 2 and i % 40 != 1), ("c", i % 97 == 1 or i > 392), ("d", i % 2))]
    put = lambda df: spark.createDataFrame(df.collect(), df.schema)
    scopes = spark.createDataFrame(rows, kind)
    ctx, small = put(facts.contexts(scopes)), put(facts.contexts(facts.profiles(scopes), fit=facts.eligible(scopes)))
    counts = put(facts.cube(ctx))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
    assert small.count() * 10 < ctx.count() and same(counts, facts.cube(small).select(counts.columns))
    spoken = put(facts.spoken(facts.scored(counts)))
    assert same(facts.fold_siblings(spoken, ctx.where("raw = 1")), facts.fold_siblings(spoken, small.where("raw > 0"), scopes=scopes))


def test_words_of_documents_with_one_group_are_not_shuffled(spark, sf_dir):
    from patternmill import catalog

    plan = catalog.queries()["source_bridge"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(tok#\d+, doc_id", plan)


def plain_lives(batches):
    """Event by event; those without a time first in their batch."""
    lives = {}
    for batch in batches:
        for key, ts, _, v in sorted(batch, key=lambda e: (e[1] is not None, e[1] or datetime(1, 1, 1), e[2])):
            first, last, mods, fixes, churn, old = lives.get(key, (None, None, 0, 0, False, v))
            first, last = first or ts, ts or last
            early = ts is not None and ts - first <= timedelta(days=14)
            lives[key] = (first, last, mods + (v != old), fixes + (v == "error"), churn or (v != old and early), v)
    return lives


def test_a_stream_brings_each_key_to_its_state_once_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, kind, batches = np.random.default_rng(7), "key string, ts timestamp, ord long, v string", []
    for part in range(3):
        pick = lambda i: (f"k{k}" if (k := rng.integers(0, 40)) else None, datetime(2024, 1, 1 + 10 * part) + timedelta(hours=int(rng.integers(0, 240))) if i % 17 else None, i, [None, "a", "b", "error"][rng.choice(4, p=[0.1, 0.6, 0.2, 0.1])])  # noqa: E731, B023
        batches.append([pick(i) for i in range(400)] + [(f"n{part}", None, 1, "a"), ("edge", datetime(2024, 1, 1) + timedelta(days=[0, 14, 15][part]), 1, ["a", "b", "a"][part]),
                        ("late", datetime(2024, 1, 1) + timedelta(days=[0, 14, 15][part], seconds=part), 1, ["a", "b", "a"][part])])
        spark.createDataFrame(batches[-1], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    stream = history.lifecycles(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), buckets=8)
    keep = lambda df, n: seen.update({r.key: tuple(r)[1:] for r in df.collect()})
    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == plain_lives(batches) and not seen["late"][4] and seen["edge"][4] and None in seen
    plan = q._jsq.explainInternal(False)
    assert -1 < plan.index("TransformWithState") < plan.find("FlatMapGroupsInArrow"), "events of a key are joined before its state is read"


def test_stretches_take_all_keys_of_a_bucket_in_passes():
    rng = np.random.default_rng(8)
    n = 400_000
    key, at, v = rng.integers(0, 60_000, n), rng.integers(0, 10**9, n), rng.integers(0, 3, n)
    events = pa.table({"bucket": pa.array(np.zeros(n, "int32")), "key": key.astype(str), "at": at, "until": at + 9, "ord": np.arange(n), "v": np.array(["a", "b", "error"])[v]})
    began = time.process_time()
    out = history.stretches(events, "error")
    assert time.process_time() - began < 10, "a data frame for each of 60,000 keys takes longer"
    order = np.lexsort((np.arange(n), at, key))
    changed = (key[order][1:] == key[order][:-1]) & (v[order][1:] != v[order][:-1])
    assert len(out) == len(np.unique(key)) and sum(out["mods"].to_pylist()) == changed.sum() and sum(out["fixes"].to_pylist()) == (v == 2).sum()
