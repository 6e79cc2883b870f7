"""Each operator against a plain version, on odd rows and on no rows."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from odd_rows import line, no_documents, odd_documents  # noqa: F401
from tokenizers import Tokenizer

from retail_spark.llm import license_scan, quality_rules, weak_quality
from retail_spark.llm.components import connected_components
from retail_spark.llm.html_text import extract, main_text
from retail_spark.llm.mixing import mix_sources
from retail_spark.llm.nearest import nearest_neighbours
from retail_spark.llm.ngram_join import hamming, keys_of_set, ngram_jaccard_join, parity_sketch
from retail_spark.llm.packing import SEQUENCE_TOKENS, best_cuts, pack
from retail_spark.llm.pseudo_likelihood import pseudo_likelihood
from retail_spark.llm.tokens import TextTokenizer, tokenizer_path
from retail_spark.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(rows):
    sets = {(d, t): plain_shingles(t) for d, t in rows}
    nodes = list(sets)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 4 * both >= 3 * union:
                root[find(a)] = find(b)
    low = {}
    for n in nodes:
        low[find(n)] = min(low.get(find(n), n[0]), n[0])
    return Counter((d, len(sets[d, t]), low[find((d, t))]) for d, t in rows)


def test_join_equals_all_pairs(spark, odd_documents):
    own = spark.createDataFrame(
        [(1000 + k, re.sub(r"w50x(\d+)", lambda m, k=k: "z" if int(m[1]) * 7 % 97 < k else m[0], line(50, 300))) for k in range(30)]
        + [(2000 + k, line(60, 3 + k % 9)) for k in range(20)],
        "doc_id long, text string",
    )
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("doc_id", docs.doc_id + 5000).union(own).union(odd_documents.select("doc_id", "text").where("doc_id is not null"))
    got = Counter(tuple(r) for r in ngram_jaccard_join(docs).collect())
    assert got == plain_components([tuple(r) for r in docs.collect()])


def test_join_of_a_family_of_edits(spark):
    """Many edits of one text share blocks, and about half of them are similar to no other."""
    rng = np.random.default_rng(3)

    def edit(k):
        words = line(70, 140).split()
        for at in rng.integers(0, len(words), 1 + k % 9):
            words[at] = f"e{rng.integers(1 << 30)}"
        return " ".join(words)

    rows = [(k, edit(k)) for k in range(240)]
    rows += [(300 + k, rows[200 + k][1] + f" end{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_components(rows)
    assert 30 < len({low for _, _, low in wanted}) < 240
    assert Counter(tuple(r) for r in ngram_jaccard_join(docs).collect()) == wanted


def test_join_without_ids_or_rows(odd_documents, no_documents):
    rows = [tuple(r) for r in ngram_jaccard_join(odd_documents).collect()]
    assert len(rows) == odd_documents.count()
    assert [r for r in rows if r[0] is None] and all(r[2] is None for r in rows if r[0] is None)
    assert ngram_jaccard_join(no_documents).count() == 0


def test_sketches_bound_the_difference_and_similar_sets_share_spare_keys():
    rng = np.random.default_rng(1)
    for size in (3, 7, 15, 40, 100, 200, 600, 3000):
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = len(one) // 7
        two = np.unique(np.concatenate([one[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
        apart = len(np.setxor1d(one, two))
        assert hamming([parity_sketch(one)], [parity_sketch(two)])[0] <= apart
        common = np.empty(0, np.uint64)
        shared = np.intersect1d(keys_of_set(one, common), keys_of_set(two, common))
        assert len(shared) > min(len(one), len(two)) // 16


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "u long, v long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("module, run", [(quality_rules, quality_rules.quality_rules), (license_scan, license_scan.license_scan)])
def test_against_sql(odd_documents, no_documents, module, run):
    con = duckdb.connect()
    con.register("documents", odd_documents.toArrow())
    result = con.execute(module.ORACLE_SQL)
    names = [d[0] for d in result.description]
    wanted = Counter(map(repr, result.fetchall()))
    assert Counter(repr(tuple(r)) for r in run(odd_documents).select(*names).collect()) == wanted
    assert run(no_documents).count() == 0


def test_toxicity(spark, odd_documents, no_documents):
    texts = [(k, line(k, 30) + (" you idiot, idiot trash" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(150)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in texts] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity(docs, labels).collect()
    assert [r.predicted for r in sorted(rows)] == [y for _, _, y in texts]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    odd = toxicity(odd_documents, labels.limit(0)).collect()
    assert len(odd) == odd_documents.count() and {r.score for r in odd} == {0.0}
    assert toxicity(no_documents, labels).count() == 0


def test_tokens_equal_the_library(spark, odd_documents):
    exact, own = Tokenizer.from_file(tokenizer_path()), TextTokenizer(tokenizer_path())
    texts = [r.text or "" for r in odd_documents.collect() + spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts + ["Don't THE'RE 12a3 ___ ß. ßß, x\x0by\x1cz \x7f a b", "'s 'll!!! ??x"]:
        assert own.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(20):
        places = np.unique(np.concatenate([[0], rng.integers(1, 200, 25)]))
        penalty = rng.integers(0, 6, len(places))
        steps = np.diff(places).max()
        longest = 1 << int(steps).bit_length()

        def cost(cuts, places=places, penalty=penalty, longest=longest):
            sizes = np.diff(cuts)
            return sum(0 if s & (s - 1) == 0 else longest - s for s in sizes) + sum(penalty[np.searchsorted(places, c)] for c in cuts[1:])

        best = [0] + [10**9] * (len(places) - 1)
        for i in range(1, len(places)):
            for j in range(i):
                size = places[i] - places[j]
                if size <= longest:
                    best[i] = min(best[i], best[j] + penalty[i] + (0 if size & (size - 1) == 0 else longest - size))
        assert cost(best_cuts(places, penalty, longest)) == best[-1]


def test_packing_keeps_every_id(odd_documents, no_documents):
    exact = Tokenizer.from_file(tokenizer_path())
    rows = pack(odd_documents).toPandas()
    ids = [np.array(exact.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in odd_documents.collect()]
    assert rows["length"].sum() == sum(map(len, ids))
    crcs = Counter(zlib.crc32(i.tobytes()) for i in ids if len(i) < 100)
    whole = rows[rows["length"] == rows["doc_tokens"]]
    assert not crcs - Counter(whole["ids_crc32"].tolist())
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum()[:-1]])).all()
        assert own["length"].sum() <= SEQUENCE_TOKENS
    assert pack(no_documents).count() == 0


def test_mixing_meets_budgets(spark, odd_documents, no_documents):
    rows = [(k, line(k, 5 + k % 7), "big" if k % 10 else f"s{k % 3}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs, target_entropy=0.9, most_repeats=100.0).toPandas()
    total = sum(len(t.split()) for _, t, _ in rows)
    tokens = mixed.groupby("source")["mix_tokens"].sum()
    share = tokens / tokens.sum()
    assert abs(-(share * np.log(share)).sum() / np.log(len(share)) - 0.9) < 0.01
    assert total - 12 * len(share) <= tokens.sum() <= total
    passes = mixed.groupby(["source", "mix_epoch", "doc_id"]).size()
    assert passes.max() == 1 and mixed["mix_position"].between(0, 1).all()
    limited = mix_sources(docs, target_entropy=0.9, most_repeats=1.5).toPandas()
    natural = docs.toPandas().assign(t=lambda d: d.text.str.split().str.len()).groupby("source")["t"].sum()
    assert (limited.groupby("source")["mix_tokens"].sum() / natural).max() <= 1.5
    assert mix_sources(odd_documents).count() > 0 and mix_sources(no_documents).count() == 0


def test_neighbours_against_all_distances(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)] + [(5000 + k, vectors[100].tolist(), 1) for k in range(30)]
    odd = [(9000, None, 1), (9100, [0.0] * 16, 1), (9200, [float("nan")] * 16, 1), (None, [1.0] * 16, 1), (9300, [None] * 16, 1), (0, rows[0][1], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = nearest_neighbours(table).toPandas()
    ids = np.array([r[0] for r in rows])
    points = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    hits = 0
    queries = ids[ids % 100 == 0]
    assert set(got.query_id) == set(queries.tolist())
    for q in queries:
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        want = ids[np.lexsort((ids, far))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        hits += len(set(want.tolist()) & set(own.vec_id))
    assert hits >= 0.9 * 10 * len(queries)
    assert nearest_neighbours(table.limit(0)).count() == 0
    assert nearest_neighbours(table.where("vec_id < 3")).collect()[0].rank == 1


def test_page_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><div class='top-menu'><a href=1>Home</a></div><article>"
        "<h1>T&eacute;st</h1><p>One  two,\nthree. Four, five.<br>Six, seven.</p><div class='ad'>Buy, now.</div><ul><li>item one</li></ul>"
        "<p>More text, longer, with stops. And more.</p><section id='comments'><p>I like it, a lot.</p></section></article><footer>end</footer>"
    )
    want = "Tést\nOne two, three. Four, five. Six, seven.\nitem one\nMore text, longer, with stops. And more."
    assert main_text(page) == want
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    rows = extract(pages).collect()
    assert Counter(r.text for r in rows) == {want: 2, "": 2} and all(r.n_chars == len(r.text) for r in rows)
    assert extract(pages.limit(0)).count() == 0


def test_weak_labels(spark, odd_documents, no_documents):
    patterns = np.array([[2, 2, 2], [0, 0, 0], [2, 1, 2], [0, 0, 1]])
    share, _, good = weak_quality.fit_accuracies(patterns, np.array([70, 20, 6, 4]))
    assert (good > 0.5).tolist() == [True, False, True, False] and abs(share - 0.76) < 0.05
    # One trait is one labeller: bad by any of its rules, good by any other.
    votes = np.array([[2, 2, 1, 2, 2, 2, 2, 0, 2], [1, 1, 1, 1, 1, 1, 1, 1, 1], [2, 0, 2, 1, 2, 1, 1, 1, 2]])
    assert weak_quality.by_trait(votes).tolist() == [[2, 2, 0], [1, 1, 1], [2, 0, 2]]
    junk, prose = "#$ %% | && <> || $$ " * 30, "The river runs past the old mill and the town. " * 3
    assert weak_quality.votes(junk)[1] == weak_quality.BAD and weak_quality.votes(prose)[1] == weak_quality.GOOD
    rows = weak_quality.quality_classifier(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert weak_quality.quality_classifier(no_documents).count() == 0


def test_pseudo_likelihood(spark, odd_documents, no_documents):
    order = " ".join(["alpha beta gamma delta epsilon zeta"] * 60)
    rng = np.random.default_rng(5)
    mixed = " ".join(rng.permutation(order.split()))
    docs = spark.createDataFrame([(k, order) for k in range(200)] + [(999, mixed)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudo_likelihood(docs).collect()}
    assert rows[0].mean_log_likelihood > rows[999].mean_log_likelihood and rows[0].n_words == 360
    odd = pseudo_likelihood(odd_documents).collect()
    assert len(odd) == odd_documents.count()
    assert all(r.mean_log_likelihood is None and r.log_likelihood == 0 for r in odd if r.n_words == 0)
    assert pseudo_likelihood(no_documents).count() == 0
