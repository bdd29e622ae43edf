"""The Merkle manifest against a tree built in memory."""

import hashlib
import zlib

import duckdb
import pytest

from netstate.llm import merkle, queries, statements
from tests.helpers import SMALL
from tests.llm.samples import odd
from tools.check_queries import compare


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([digest(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def path(rows, at):
    out = []
    for row in rows[:-1]:
        other = at ^ 1
        out.append(None if other >= len(row) else (other < at, row[other]))
        at >>= 1
    return out


def fold(node, steps):
    for step in steps:
        node = digest(node) if step is None else digest(step[1], node) if step[0] else digest(node, step[1])
    return node


def expected(rows):
    encode = lambda values: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    groups = {}
    for r in rows:
        values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        leaf = own = digest(encode(values))
        if r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0:
            own = digest(encode([*values[:3], r.n_chars + 1, r.text]))
        groups.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, leaf), r.doc_id, leaf, own))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([row[2] for row in sorted(groups[g], key=lambda row: row[0])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    root = top[-1][0]
    for place, g in enumerate(order):
        for i, (_, key, leaf, own) in enumerate(sorted(groups[g], key=lambda row: row[0])):
            steps = path(trees[g], i) + path(top, place)
            folded = fold(own, steps)
            yield key, leaf, trees[g][-1][0], root, digest(*[s[1] for s in steps if s]), folded, folded == root


def same(got, rows):
    text = lambda row: tuple(map(str, row))
    return sorted(map(tuple, got), key=text) == sorted(expected(rows), key=text)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_a_tree_in_memory(spark, levels):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert same(merkle.manifest(docs, levels=levels).collect(), docs.collect())


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    assert same(merkle.manifest(docs, levels=1).collect(), docs.collect())
    single = docs.limit(1)
    assert same(merkle.manifest(single).collect(), single.collect())
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_query_equals_its_statement(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.QUERIES["op12_merkle_manifest"](spark, SMALL).toPandas()
    assert compare(got, db.sql(statements.OP12).df()).startswith("ok")


def test_versions_copy_only_the_ancestors_of_the_changed_leaf(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    proven = merkle.manifest(docs, levels=3, paths=True).cache()
    rows = proven.collect()
    changed = [r for r in rows if r.copies is not None]
    assert changed and all(not r.verified for r in changed) and all(r.verified for r in rows if r.copies is None)
    assert all(len(r.copies) == len(r.path) and r.copies[-1] == r.folded_root for r in changed)
    owned = merkle.version_nodes(proven)
    assert owned.count() == sum(len(r.path) for r in changed)
    assert owned.groupBy("doc_id").count().count() == len(changed)
