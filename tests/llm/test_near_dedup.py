import random

from twinbuild.llm import near_dedup
from twinbuild.llm.near_dedup import Banding, components, least_matches, near_duplicates, one_of_each


def brute(rows, width, percent=80):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in ids}


def check(got, rows, width):
    want = brute(rows, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def made(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(n):
        kind = k % 6
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        if kind in (1, 2) and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 3:
            words = passage + words[:20]
        elif kind == 4:
            words = words[: rng.randint(0, 3)]
        rows.append((k * 3 % n if n % 3 else k, " ".join(words)))
    return rows


def test_against_brute_force(spark):
    rows = made()
    for width in (2, 5):
        check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Banding(width=width)).collect(), rows, width)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(near_duplicates(docs, Banding(width=2)).collect(), rows, 2)


def test_group_of_copies_and_chain(spark):
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(base)) for k in range(300)]
    rows += [(300 + k, " ".join([*base[: k // 3], f"n{k}", *base[k // 3 :]])) for k in range(300)]
    rows += [(1000 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 60))) for k in range(40)]  # each is like the next one only
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Banding(width=2)).collect(), rows, 2)


def edited(words, times, rng):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies with up to 14 words changed each: each is like the centre or, nearly always, like nothing, so few others need a test."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(146)]
    rows = [(k, " ".join(edited(base, rng.randint(0, 14), rng))) for k in range(800)]
    tested, plausible = [], near_dedup._plausible
    monkeypatch.setattr(near_dedup, "_plausible", lambda pairs, *a: tested.append(pairs.count()) or plausible(pairs, *a))
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 5)
    assert len(tested) == 2 and tested[1] < len(rows) // 8


def test_links_between_what_is_not_like_the_centre(spark):
    """Pairs that share additions to a common origin, that lack the same of it, and that do both."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(140)]
    rows = [base, *(edited(base, 1, rng) for _ in range(20))]
    for k in range(12):
        own = edited(base, 5, rng)  # adds
        rows += [own, edited(own, 1, rng), edited(own, 2, rng)]
        at, size = rng.randrange(100), rng.randint(26, 40)
        own = base[:at] + base[at + size :]  # lacks
        rows += [own, own[: at - 3] + own[at:] if at > 3 else own[5:], edited(own, 1, rng), own[:-4]]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 5)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(70, 60), (60, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 70: 60, 60: 60}


def test_defined_cases(odd, nothing):
    got = {}
    for r in near_duplicates(odd).collect():
        got.setdefault(r["doc_id"], r)
    assert got[0]["n_shingles"] == 0 and got[0]["component_id"] == 0 and got[2]["kept"]
    assert got[6]["component_id"] == 5 and not got[6]["kept"] and got[None]["component_id"] is None and got[None]["kept"]
    assert near_duplicates(nothing).collect() == []
    kept = one_of_each(odd, near_duplicates(odd))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10]


def test_bound_is_the_binomial_tail():
    assert least_matches(10, 0.5, 1.0) == 10 and least_matches(10, 0.8, 0.0) == 0 and least_matches(240, 0.8, 1e-7) > 140
