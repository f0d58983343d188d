from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from twinbuild.llm import merkle_manifest as M


def sha(x):
    return sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return sha(field(r["doc_id"]) + field(r["source"]) + field(r["lang"]) + field(n) + field(r["text"]))


def tree(nodes):
    """The root, and for each leaf its siblings with whether they stand on the left."""
    ways, own, level = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [level[k : k + 2] for k in range(0, len(level), 2)]
        for k, run in enumerate(runs):
            for j in range(len(run)):
                for i in own[2 * k + j]:
                    ways[i].append((j == 1, run[1 - j] if len(run) == 2 else None))
        own = [sum(own[k : k + 2], []) for k in range(0, len(level), 2)]
        level = ["".join(run) for run in runs]
        level = [sha(x) for x in level]
    return level[0], ways


def manifest(rows, tampered=lambda r: False):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    subs = {x: tree([leaf(r) for r in g]) for x, g in groups.items()}
    root, tops = tree([subs[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, way in zip(groups[x], subs[x][1], strict=True):
            way, at = way + tops[k], leaf(r, int(tampered(r)))
            for on_left, other in way:
                at = sha((other or "") + at if on_left else at + (other or ""))
            out.append((r["doc_id"], leaf(r), subs[x][0], root, sha("".join(d for _, d in way if d)), at, at == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(df):
    return sorted((tuple(r) for r in df.withColumnRenamed("id", "doc_id").select(*COLUMNS).collect()), key=str)


def test_query_against_brute_force(spark, sf_dir):
    from twinbuild.llm.queries import op12_merkle_manifest

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = rows_of(op12_merkle_manifest(spark, sf_dir))
    assert got == manifest(rows, lambda r: crc32(str(r["doc_id"]).encode()) % 7 == 0)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 5


@pytest.mark.parametrize("levels", [1, 3])
def test_blocks_of_any_height(spark, levels):
    """Trees of 1 to 21 leaves, so that right edges and lone nodes of all kinds come up, through several rounds of builders."""
    rows = [(k, f"t{k}", f"l{n}" if n else None, "s", k) for n in range(22) for k in range(100 * n, 100 * n + max(n, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(M.verified(*M.manifest(docs, levels=levels), levels=levels)) == manifest(docs.collect())


@pytest.mark.parametrize("levels", [2])
def test_log_is_in_postorder(spark, levels):
    leaves = spark.createDataFrame([(f"1{n}", k, n, sha(f"{n} {k}")) for n in range(1, 20) for k in range(n)], "tree string, number long, leaves long, digest string")
    log = M.build_log(leaves, levels).collect()

    def postorder(n):
        out = []

        def visit(level, number):
            if level:
                for child in (2 * number, 2 * number + 1):
                    if child < M._nodes(n, level - 1):
                        visit(level - 1, child)
            out.append((level, number))

        visit(M.height(n), 0)
        return out

    for n in range(1, 20):
        own = sorted((r["place"], r["level"], r["number"]) for r in log if r["leaves"] == n)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == postorder(n)


def test_proofs_fold_to_the_root(spark, odd):
    leaves, log, top = M.manifest(odd.select(*M.HASHED))
    nothing = M.roots(log.where("tree <> ''")).select("tree", F.array().cast(M.WAY).alias("way"))
    known = {r["tree"]: r["root"] for r in M.roots(log).collect()}
    for r in M.proofs(leaves, log.where("tree <> ''"), nothing, ("tree", "digest")).collect():
        assert M.fold(r["digest"], [tuple(w) for w in r["way"]]) == r["folded"] == known[r["tree"]]


def test_cases(spark, odd, nothing):
    assert rows_of(M.verified_with(odd)) == manifest(odd.collect())  # nulls everywhere, repeated rows and ids
    assert M.verified_with(nothing).collect() == []
    one = M.verified_with(odd.where("doc_id = 3")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("")
    wrong = M.verified_with(odd, F.when(F.col("doc_id") == 3, F.lit("0" * 64))).collect()
    assert {r["id"]: r["verified"] for r in wrong}[3] is False and sum(not r["verified"] for r in wrong) == 1
