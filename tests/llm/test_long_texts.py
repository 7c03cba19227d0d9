"""Texts of 20,000 words through every query: what is planted at their far ends is found. And the flow's cost against brute force."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("shellcluster.llm")

from test_llm_small import words

from shellcluster.llm import mixing, queries

N = 20_000
ITEM = "which of the seven lakes that nobody has named so far lies farthest from the road to the northern harbour"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    lexicon = [f"v{i}" for i in range(6000)] + ["the", "of", "and", "Été"]
    draw = lambda n: list(rng.choice(lexicon, n))
    passage = draw(30)
    first = draw(N)
    near = list(first)
    for i in range(50, N, 1500):
        near[i] = f"changed{i}"
    other = [*draw(N - 60), *ITEM.split(), *passage]
    return {0: " ".join(first), 1: " ".join(near), 2: " ".join(other), 3: " ".join([*draw(N), *passage])} | {i: " ".join(draw(30)) for i in range(10, 50)}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(10, 50)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sizes_and_rules(spark, folder, texts):
    mixed, judged = by_id(queries.op1_mixing(spark, folder)), by_id(queries.op9_quality_rules(spark, folder))
    for i, t in texts.items():
        assert mixed[i]["size"] == judged[i]["n_words"] == len(words(t))
        grams = Counter(zip(words(t), words(t)[1:], words(t)[2:]))
        repeated = {p for j, g in enumerate(zip(words(t), words(t)[1:], words(t)[2:])) if grams[g] > 1 for p in range(j, j + 3)}
        assert judged[i]["n_repeat_words"] == len(repeated)


def test_token_files(spark, folder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = by_id(queries.op3_dac(spark, folder))
    for i in (0, 2, 3):
        assert found[i]["n_tokens"] == len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1


def test_planted_at_the_end(spark, folder, texts):
    assert {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, folder).collect()} == {(2, 1)}
    removed = by_id(queries.op10_suffix_dedup(spark, folder))
    wanted = {i: set() for i in texts}
    seen = set()
    for i in sorted(texts):
        w = words(texts[i])
        for j in range(len(w) - 19):
            g = tuple(w[j : j + 20])
            if g in seen:
                wanted[i].update(range(j, j + 20))
            seen.add(g)
    for i, t in texts.items():
        kept = " ".join(w for j, w in enumerate(words(t)) if j not in wanted[i])
        assert removed[i]["n_removed"] == len(wanted[i]) and removed[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert len(wanted[3]) == 30 and len(wanted[1]) > N // 2
    first = queries.op12_block_wand(spark, folder).where("rank = 1").first()
    assert first["item_id"] == 1 and first["score"] > 0


def test_near_copies(spark, folder):
    found = by_id(queries.op6_jaccard_join(spark, folder))
    assert found[1]["class_id"] == 0 and found[0]["n_links"] == found[1]["n_links"] == 1 and found[2]["n_links"] == 0


def test_models(spark, folder, texts):
    for query in (queries.op4_quality_classifier, queries.op7_toxicity):
        found = by_id(query(spark, folder))
        assert all(0 <= r["score"] <= 1 for r in found.values()) and set(found) == set(texts)
    scored = by_id(queries.op8_context_mixing(spark, folder))
    assert all(scored[i]["n_tokens"] == len(words(t)) + 1 and math.isfinite(scored[i]["score"]) and scored[i]["score"] < 0 for i, t in texts.items())


@pytest.mark.parametrize("seed", range(12))
def test_least_cost(seed):
    """Of all whole flows that give the most tokens none costs less: the k-th pass of a pattern costs k a token."""
    rng = np.random.default_rng(seed)
    members = {"p": ["a", "b"], "q": ["b"], "r": ["a"]}
    capacity = {p: int(rng.integers(0, 4)) for p in members}
    quota = {s: int(rng.integers(0, 7)) for s in "ab"}
    arcs = [(p, s) for p, m in members.items() for s in m]

    def worth(flow):
        given = Counter()
        for (p, _), x in zip(arcs, flow):
            given[p] += x
        taken = Counter()
        for (_, s), x in zip(arcs, flow):
            taken[s] += x
        if any(given[p] > 2 * capacity[p] for p in members) or any(taken[s] > quota[s] for s in quota):
            return None
        return sum(flow), -sum(max(0, given[p] - capacity[p]) for p in members)

    best = max(w for flow in itertools.product(range(7), repeat=len(arcs)) if (w := worth(flow)) is not None)
    found = mixing.min_cost_flow(capacity, members, quota, 2)
    assert worth([found.get(a, 0) for a in arcs]) == best
