import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from litsift.llm import merkle
from litsift.llm.common import Scratch
from litsift.llm.queries import ORACLES

from . import rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def expected(table):
    """What the contract asks for of (doc_id, source, lang, n_chars, text) rows, by plain lists."""
    def leaf(r, add=0):
        return sha("".join(map(field, (*r[:3], None if r[3] is None else r[3] + add, r[4]))))

    groups = {}
    for r in table:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]]) for g in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[k], i) + siblings(top, k)
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for right, other in path:
                node = sha((other or "") + node if right else node + (other or ""))
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], sha("".join(o or "" for _, o in path)), node,
                        node == top[-1][0]))
    return out


def query(spark, tmp_path, table, extra=""):
    schema = "doc_id long, source string, lang string, n_chars long, text string" + extra
    path = str(tmp_path / "sf")
    spark.createDataFrame(table, schema).write.parquet(f"{path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 3, 256, 257])
def test_sizes_around_the_stored_blocks(spark, tmp_path, n):
    table = [(i, "s", "en" if i % 9 else "de", i, f"text {i}") for i in range(n)] + [(n, None, None, None, None)]
    assert query(spark, tmp_path, table) == sorted(expected(table), key=repr)


def test_more_levels_than_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    table = [(i * 3, "s", f"g{i % 21}" if i % 2 else "hot", i, f"text {i}") for i in range(300)]
    assert query(spark, tmp_path, table) == sorted(expected(table), key=repr)


def test_awkward_rows(spark, tmp_path):
    table = [(r[0], None, r[2], len(r[1] or ""), r[1], "x", 1, 2) for r in rows.ROWS]
    table += [(7, "s", "en", 2**63 - 1, "t", "x", 1, 2)] * 3 + [(0, "", "", 0, "", "x", 1, 2)]
    got = query(spark, tmp_path, table, ", grp string, pos int, hash int")
    assert got == sorted(expected([r[:5] for r in table]), key=repr)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_manifest_and_one_wrong_sibling(spark):
    table = spark.range(700).select(F.lit("a").alias("g"), "id", merkle.leaf(F.col("id")).alias("hash"),
                                    F.struct("id").alias("row"))
    made = merkle.build(table, "g", ["id"], Scratch(spark, "test"))
    assert [level.count() for level in made.groups] == [3, 1]  # two stored levels, those between are not
    root = made.root().first()["root"]
    proofs = made.proofs()
    assert proofs.filter(merkle.folded(F.col("hash"), F.col("proof")) == root).count() == 700
    wrong = F.transform("proof", lambda x, i: F.when(i == 4, F.concat(F.substring(x, 1, 1), F.lit("0" * 64))).otherwise(x))
    assert proofs.filter(merkle.folded(F.col("hash"), wrong) == root).count() == 0


def test_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(ORACLES["op11_merkle_manifest"]).fetchall()
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, path).collect()]
    assert sorted(got) == sorted(want)
