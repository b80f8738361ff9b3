"""Each operator against a plain version, on small driver tables and on frames with the hard cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from patternmill.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules, queries, sharding, substring_dedup, suffix_dedup, toxicity, url_filter
from patternmill.llm.sql import ORACLE
from tests.llm import brute
from tests.parity import same


def docs_of(spark, sf_dir, n=None):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    return rows[:n] if n else rows


def rows_of(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, ORACLE[name])


# packing


def check_packing(rows, out, tok, capacity=2048):
    want = Counter()
    for d, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want[d, len(ids) // 4, ids] += 1
    got = defaultdict(list)
    for r in out:
        got[r.sequence_id].append((r.offset, r.length))
    for places in got.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    expect = Counter()
    for (d, total, ids), n in want.items():
        starts = sorted({(r.start, r.length) for r in out if r.doc_id == d and r.doc_tokens == total})
        for start, length in starts:
            expect[d, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total] += n
        assert sum(length for _, length in starts) == total
    assert pieces == expect
    return len(got)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(d, t) for d, t, _ in docs_of(spark, sf_dir)]
    out = packing.pack_documents(brute.frame(spark, rows), queries.tokenizer_path).collect()
    used = check_packing(rows, out, tok)
    assert used <= math.ceil(sum(r.length for r in out) / 2048 * 1.02) + 1
    hard = [r for r in brute.hard_rows() if r[0] is not None]
    check_packing(hard, packing.pack_documents(brute.frame(spark, hard), queries.tokenizer_path, group_docs=3).collect(), tok)
    assert packing.pack_documents(brute.frame(spark, []), queries.tokenizer_path).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 400):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free: list[int] = []
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - free[b])
            free[b] -= int(lengths[i])


# toxicity


def test_grammar():
    lexicon = toxicity.Lexicon({w: 1.0 for w in toxicity.SEEDS[toxicity.INSULT] + toxicity.SEEDS[toxicity.THREAT]}, {})
    score = lambda t: sum(toxicity.clause_scores(t, lexicon, toxicity.grammar())[0])
    plain, aimed, denied, reported = map(score, ("the idiot came", "you idiot", "he is not an idiot", "he said idiot"))
    assert denied < reported < aimed and plain < aimed and reported < plain
    assert score("i will hurt you") > score("the words hurt me") > 0
    assert score("a quiet day. nothing here") == 0
    assert score("not today. you idiot") == aimed, "a clause ends what it denies"


def test_toxicity(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    for r in out.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    marked = [(r.toxic, out[r.doc_id].score) for r in labels.collect() if out[r.doc_id].held_out]
    pos, neg = [s for y, s in marked if y], [s for y, s in marked if not y]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    assert auc > 0.85, auc  # some 225 rows teach it, of which some 30 are toxic, in four languages


def test_toxicity_hard(spark):
    rows = brute.hard_rows()
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0)):
        assert len(toxicity.score_toxicity(brute.frame(spark, rows), y).collect()) == len(rows)
        assert toxicity.score_toxicity(brute.frame(spark, []), y).count() == 0


# decontamination


def test_leaks(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t, _ in docs_of(spark, sf_dir)] + [(9000 + i, f"Before it, some words. {t} And after.") for i, t in items]
    rows += [(None, items[0][1]), (9990, " ".join(f"filler{i}" for i in range(20_000)) + " " + items[1][1]), (9990, "again " + items[1][1])] + brute.hard_rows()
    more = [*items, (None, items[2][1]), (77_000, None), (77_001, ""), (77_002, "four words are few"), (77_003, "one two three four five")]
    table = spark.createDataFrame([(i, t, "x") for i, t in more], "item_id long, text string, doc_id string")
    got = rows_of(decontaminate.find_leaks(brute.frame(spark, rows), table), "doc_id", "item_id", "n_shingles", "n_found")
    best = {}
    for d, i, n, f in brute.leaks(rows, more):
        best[d, i] = max(best.get((d, i), (0, 0)), (n, f))
    assert got == sorted([(d, i, n, f) for (d, i), (n, f) in best.items()], key=str)
    assert {(9000 + i, i) for i, t in items if len(brute.tokens(t)) >= 5} <= {(d, i) for d, i, _, _ in got}
    wide = decontaminate.find_leaks(brute.frame(spark, rows), table, broadcast_rows=0)
    assert rows_of(wide, "doc_id", "item_id", "n_shingles", "n_found") == got
    kept = {r.doc_id for r in decontaminate.without_leaks(brute.frame(spark, rows), table).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _, _ in got}
    assert decontaminate.find_leaks(brute.frame(spark, []), table).count() == 0
    assert decontaminate.find_leaks(brute.frame(spark, rows), table.limit(0)).count() == 0


def test_short_items(spark):
    """Items of fewer than five words are found where all their words stand in a row."""
    items = [(1, "Zebra"), (2, "blue Whale"), (3, "one two, three"), (4, "four words are few"), (5, "one two three four five"), (6, "?!"), (7, None)]
    rows = [(10, "a zebra and a BLUE whale"), (11, "zebra"), (12, "blue and whale; zebras"), (13, "so one two three four five"), (14, "four words, are few"), (15, "four words are very few"), (16, ""), (None, "zebra")]
    table = spark.createDataFrame(items, "item_id long, text string")
    held = {(d, i) for d, t in rows for i, x in items if brute.tokens(x) and f" {' '.join(brute.tokens(x))} " in f" {' '.join(brute.tokens(t))} "}
    assert held == {(10, 1), (10, 2), (11, 1), (None, 1), (13, 3), (13, 5), (14, 4)}
    for size in (2_000_000, 0):
        out = decontaminate.find_leaks(brute.frame(spark, rows), table, broadcast_rows=size)
        assert rows_of(out, "doc_id", "item_id", "n_shingles", "n_found") == sorted([(d, i, 1, 1) for d, i in held], key=str)


# near duplicates


def test_near_duplicates(spark, sf_dir):
    rows = [(d, t) for d, t, _ in docs_of(spark, sf_dir)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(brute.frame(spark, rows)).collect()}
    assert got == brute.classes(rows)
    kept = {r.doc_id for r in near_dedup.one_of_each(brute.frame(spark, rows)).collect()}
    assert kept == set(got.values())


def test_near_duplicates_hard(spark):
    hard = [r for r in brute.hard_rows() if r[0] is not None]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(brute.frame(spark, hard)).collect()}
    assert got == brute.classes(hard)
    assert near_dedup.near_duplicates(brute.frame(spark, brute.hard_rows())).count() == len(brute.hard_rows())
    assert near_dedup.near_duplicates(brute.frame(spark, [])).count() == 0
    one = near_dedup.one_of_each(brute.frame(spark, brute.hard_rows()))
    assert one.columns == brute.SCHEMA.names and one.where("doc_id = 2").count() == 0


def test_chains_and_crowds(spark):
    """A crowd of near copies, a chain whose ends differ, and texts that share half of their words only."""
    base = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(w if j != i else f"n{i}" for j, w in enumerate(base))) for i in range(60)]
    chain = [" ".join(f"k{j}" for j in range(6 * i, 6 * i + 120)) for i in range(12)]
    rows += [(100 + i, t) for i, t in enumerate(chain)]
    half = [f"h{j}" for j in range(60)]
    rows += [(200 + i, " ".join(half + [f"u{i}_{j}" for j in range(40)])) for i in range(40)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(brute.frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(3)
    m, agree, want = 512, [], []
    for _ in range(20):
        keys = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        x = near_dedup.bag_min_hash(keys[a > 0], a[a > 0], m)
        y = near_dedup.bag_min_hash(keys[b > 0], b[b > 0], m)
        agree.append(np.mean(x == y))
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    assert np.abs(np.array(agree) - want).max() < 0.12


@pytest.mark.parametrize(("one", "other"), [(3, 4), (5, 4), (5, 8), (7, 4), (7, 8), (250, 260)])
def test_bag_min_hash_reaches_the_largest_count(one, other):
    rng = np.random.default_rng(4)
    agree = []
    for _ in range(10):
        keys = rng.integers(1, 1 << 62, 12).astype(np.uint64)
        x, y = (near_dedup.bag_min_hash(keys, np.full(12, n), 512) for n in (one, other))
        agree.append(np.mean(x == y))
    assert abs(np.mean(agree) - min(one, other) / max(one, other)) < 0.03


def test_repeated_phrases_are_near_duplicates(spark):
    """One phrase seven and eight times, whose largest counts lie on both sides of a power of two."""
    rows = []
    for i in range(30):
        phrase = " ".join(f"p{i}x{j}" for j in range(20))
        rows += [(2 * i, " ".join([phrase] * 7)), (2 * i + 1, " ".join([phrase] * 8))]
    want = brute.classes(rows)
    assert want == {d: d - d % 2 for d, _ in rows}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(brute.frame(spark, rows)).collect()} == want


def test_ids_that_repeat_or_lack(spark):
    """Each row is judged by its own text; a class is named by its smallest id, or by none."""
    base = lambda k: " ".join(f"{k}{j}" for j in range(60))
    a, b = base("a"), base("b")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, base("c")), (None, base("c") + " more"), (None, base("e")), (9, base("e"))]
    got = rows_of(near_dedup.near_duplicates(brute.frame(spark, rows)), "doc_id", "class_id")
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, None), (None, None), (None, 9), (9, 9)], key=str)
    kept = sorted((r.doc_id or 0, r.text) for r in near_dedup.one_of_each(brute.frame(spark, rows)).collect())
    assert len(kept) == 4 and {(1, a), (1, b), (9, base("e"))} <= set(kept)


def test_crowd_without_a_centre(spark):
    """Texts that all share buckets and whose pairs lie on both sides of the threshold, more than the pivots resolve."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        words = [f"c{j}" for j in range(150)]
        for j in rng.choice(30, 3 + i % 3, replace=False) * 5:
            words[j] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(brute.frame(spark, rows), pivots=1).collect()}
    assert got == brute.classes(rows)


# urls


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/1", "x://example.org/en/2", "x://a.org?/no", "x://fr.com/fr/x", "x://com/fr/", "x://b.com/de", "x://b.com/de/1",
            "a://b://c.com/fr/1", "x://spam-farm.example.org/", "x://sub.spam-farm.example.org", "x://notexample.org/es/", "x://ÉXAMPLE.org/É", "x://org/", "x://.org/", "x://example.org/es"]
    rows = [(i, u, "host", "rule") for i, u in enumerate(urls)] + [(None, urls[4], "", ""), (1, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    out = url_filter.filter_urls(pages, url_filter.UrlRules(queries.URL_RULES, queries.LISTED_HOSTS))

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
            path = rest[end:]
            path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fit = [(len(r), r, v) for v, r in queries.URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fit:
            _, rule, verdict = max(fit)
            return host, path, rule, verdict
        listed = any(host == h or host.endswith("." + h) for h in queries.LISTED_HOSTS)
        return host, path, None, "block" if listed else "allow"

    assert rows_of(out, "page_id", "host", "path", "rule", "verdict") == sorted([(i, *plain(u)) for i, u, _, _ in rows], key=str)
    assert url_filter.filter_urls(pages.limit(0), url_filter.UrlRules(queries.URL_RULES)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.UrlRules([])).collect()} == {"allow"}


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "key", lambda text: len(text))
    path = tmp_path / "d"
    path.write_bytes(b"".join(url_filter.DigestArray.build([("ab", 1), ("cd", 2), ("x", 3)])))
    assert url_filter.DigestArray(str(path)).find(["cd", "ab", "zz", "x", "y", ""]) == [2, 1, None, 3, None, None]


# quality


def quality_plain(rows, min_docs=20, share=0.1):
    host_docs, seen = defaultdict(set), defaultdict(set)
    key = lambda x: x.strip(" \t\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for _, t, s in rows:
        host_docs[s].add(t or "")
        for x in (t or "").split("\n"):
            if brute.words(x):
                seen[s, key(x)].add(t or "")
    out = []
    for d, t, s in rows:
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lost = sum(len(brute.words(x)) for x in lines if len(seen[s, key(x)]) > min_docs and len(seen[s, key(x)]) > share * len(host_docs[s]))
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        left = len(w) - lost
        out.append((d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), failed, not failed and not (lost > 0 and (left < 10 or left < 0.3 * len(w)))))
    return sorted(out, key=str)


def without_boilerplate(rows, min_docs=20, share=0.1):
    """(id, text, host) -> the text without the lines that too many of the host's documents have."""
    key = lambda x: x.strip(" \t\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    texts, seen = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for x in (t or "").split("\n"):
            if brute.words(x):
                seen[s, key(x)].add(t or "")
    often = lambda s, x: brute.words(x) and len(seen[s, key(x)]) > min_docs and len(seen[s, key(x)]) > share * len(texts[s])
    return {(d, t, s): t and "\n".join(x for x in t.split("\n") if not often(s, x)) for d, t, s in rows}


def test_quality(spark):
    rows = [(i, f"Accept all the cookies of this host please and then go on reading it\n{'own words ' * (i % 7)}only number {i}", "h1") for i in range(40)]
    rows += [(100 + i, f"accept ALL the cookies of this host please and then go on reading it \nonly number {i}", None if i % 2 else "h2") for i in range(50)]
    rows += [(200, "a # b $ c | <d>\n\n \na # b $ c | <d>\nlong line of a good many words that stand only here today", "h1")] + [(d and d + 500, t, "h3") for d, t in brute.hard_rows()]
    rows += [(300 + i, "accept all the cookies of this host please and then go on reading it\n" + " ".join(f"w{i}x{j}" for j in range(14)) + "\n", "h1") for i in range(5)]
    out = quality_rules.quality_rules(brute.frame(spark, rows))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = quality_plain(rows)
    assert rows_of(out, *names) == want
    assert len({w[-1] for w in want if not w[-2]}) == 2, "the fixture holds depleted documents and kept ones"
    kept = sorted(((r.doc_id, r.text) for r in quality_rules.keep_good(brute.frame(spark, rows)).collect()), key=str)
    good = {w[0] for w in want if w[-1]}
    cleaned = without_boilerplate(rows)
    assert kept == sorted([(d, cleaned[d, t, s]) for d, t, s in rows if d in good], key=str)
    assert any(t != cleaned[d, t, s] for d, t, s in rows if d in good), "a kept document loses lines"
    assert quality_rules.quality_rules(brute.frame(spark, [])).count() == 0


# substring and suffix dedup


def repeats():
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(60), text(35), text(34), text(140)]
    rows = [(i, f"{text(20)} {shared[i % 4]} {text(30)}" + (f"\t{shared[(i + 1) % 4]}" if i % 3 else "")) for i in range(30)]
    rows += [(50, text(80)), (51, "ab " * 200), (52, "q" * 49), (53, "q" * 50), (54, "q" * 50), (49, "q" * 51)]
    return rows + brute.hard_rows()


def test_substrings(spark):
    rows = repeats()
    assert rows_of(substring_dedup.remove_repeats(brute.frame(spark, rows), chunk_bytes=20_000), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.remove_words(rows), key=str)
    assert substring_dedup.remove_repeats(brute.frame(spark, [])).count() == 0


def test_suffixes(spark):
    rows = repeats()
    assert rows_of(suffix_dedup.remove_substrings(brute.frame(spark, rows), chunk_bytes=20_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.remove_bytes(rows), key=str)
    assert suffix_dedup.remove_substrings(brute.frame(spark, [])).count() == 0


def test_suffixes_of_one_id(spark):
    """Rows of one id lie in several chunks, and don't remove each other's bytes."""
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(40) for _ in range(6)]
    rows = [(5 if i % 3 else i // 3, f"{text(15)} {shared[i % 6]} {text(10)}") for i in range(60)] + [(None, f"{shared[i % 6]} {text(9)}") for i in range(20)]
    got = suffix_dedup.remove_substrings(brute.frame(spark, rows), chunk_bytes=2000)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.remove_bytes(rows), key=str)


def test_suffixes_of_documents(spark, sf_dir):
    rows = [(d, t) for d, t, _ in docs_of(spark, sf_dir, 120)]
    assert rows_of(suffix_dedup.remove_substrings(brute.frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.remove_bytes(rows), key=str)


# line dedup


def test_lines(spark):
    rows = [(i, f"Shared Line \nown {i}\n\nnine" if i < 9 else f"  shared line\r\nown {i}") for i in range(12)] + brute.hard_rows()
    want = sorted([(d, n, x, brute.sha(t)) for d, n, x, t in brute.drop_lines(rows)], key=str)
    for batches in (8, 11):
        assert rows_of(line_dedup.line_dedup(brute.frame(spark, rows), batches=batches), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    out = line_dedup.without_frequent_lines(brute.frame(spark, rows))
    assert out.columns == brute.SCHEMA.names
    assert sorted((brute.sha(r.text or "") for r in out.collect())) == sorted(w[3] for w in want)
    assert line_dedup.line_dedup(brute.frame(spark, [])).count() == 0


def test_lines_of_one_id(spark):
    """Rows that share an id are one document; ten rows without an id and with different texts are ten."""
    rows = [(1, f"often\nown {i}") for i in range(20)] + [(None, f"rare\nother {i}") for i in range(10)]
    out = {r.kept_sha256 for r in line_dedup.line_dedup(brute.frame(spark, rows)).collect()}
    assert out == {brute.sha(f"often\nown {i}") for i in range(20)} | {brute.sha(f"other {i}") for i in range(10)}


def test_names_clash(spark):
    """Columns with the names that joins use inside pass through."""
    names = ["doc_id", "text", "source", "hits", "left", "row", "d", "u", "n_lines", "keep", "kept", "gone", "node", "comp", "__hits", "__keep"]
    docs = spark.createDataFrame([(i, f"shared line\nsome ten words of document number {i} that differ from one to another {i * i}", "s", *["x"] * 13) for i in range(12)], names)
    lines = line_dedup.without_frequent_lines(docs)
    assert lines.columns == names and {r.text.split("\n")[0][:4] for r in lines.collect()} == {"some"}
    one = near_dedup.one_of_each(docs)
    assert one.columns == names and one.count() >= 1
    good = quality_rules.keep_good(docs)
    assert good.columns == names and good.count() == 12


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, limit=3, buckets=4, fanout=2)
    counted = []
    for b in range(5):
        counts = spark.createDataFrame([(h, 0, 1) for h in range(b, b + 3)], "h long, g int, n long")
        counted.append({r.h for r in runs.unseen(counts).collect()})
        runs.add(counts)
    assert [len(x) for x in runs.levels] == [1, 0, 1], "five is 101 in base two"
    seen = {h: sum(b <= h < b + 3 for b in range(5)) for h in range(7)}
    assert {r.h for r in runs.frequent().collect()} == {h for h, n in seen.items() if n >= 3}
    assert counted[4] == {4, 5, 6} - {h for h in range(7) if sum(b <= h < b + 3 for b in range(4)) >= 3}, "what the first four batches settled isn't counted again"


# sharding


@pytest.mark.parametrize("block", [1024, 16])
def test_shards(spark, sf_dir, block):
    rows = [(d, t) for d, t, _ in docs_of(spark, sf_dir)] + brute.hard_rows()
    out = sharding.shard_documents(brute.frame(spark, rows), shards=8, block=block).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted([(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows], key=str)
    at, total = defaultdict(list), Counter()
    for r in out:
        at[r.shard].append(r.slot)
        total[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in at.values()) and set(at) <= set(range(8))
    where = defaultdict(set)
    for r in out:
        where[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values()), "equal texts stay together"
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    assert max(total.values()) <= max(max(groups.values()), sum(total.values()) / 8 * 1.05)
    assert sharding.shard_documents(brute.frame(spark, [])).count() == 0


def test_differencing():
    sums, went = sharding.difference([([s, 0], i) for i, s in enumerate((8, 7, 6, 5, 4))], 2)
    assert sorted(sums) == [14, 16], "the classic example of the method"
    parts = [0, 0]
    for i, w in went:
        parts[w[0]] += (8, 7, 6, 5, 4)[i]
    assert parts == sums
