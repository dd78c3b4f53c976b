"""Page trees, faults and facts from object rows against the kernels that read a file whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import files, structure
from foliant.functions import objects as o
from foliant.operators import checks, decode, policy, tree


def tree_rows(spark, held):
    """Object rows of files {id: {number: (type, kids)}}; the root is number 1."""
    rows = [(i, n, False, json.dumps({"Type": f"/{kind}", "Kids": [f"@{k} 0" for k in kids]})) for i, nodes in held.items() for n, (kind, kids) in nodes.items()]
    return spark.createDataFrame(rows, "file_id long, node long, has_stream boolean, prim_json string").repartition(4), spark.createDataFrame([(i, 1) for i in held], "file_id long, node long")


def by_kernel(nodes, depth):
    objects = {n: (o.dictionary(Type=o.name(kind), Kids=o.array(*[o.ref(k) for k in kids])), None) for n, (kind, kids) in nodes.items()} | {0: (o.dictionary(Pages=o.ref(1)), None)}
    return list(structure.page_tree(objects, 0, depth))


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["file_id"], []).append((r["node"], r["parent"], r["level"], r["kind"]))
    return {i: sorted(x, key=lambda y: (y[0], -1 if y[1] is None else y[1])) for i, x in out.items()}


def ordered(rows):
    return sorted(rows, key=lambda y: (y[0], -1 if y[1] is None else y[1]))


def test_trees_equal_the_kernel(spark):
    rng = random.Random(1)
    held = {}
    for i in range(6):
        nodes = {1: ("Pages", [])}
        for n in range(2, 60):
            parent = rng.choice([k for k in nodes if nodes[k][0] == "Pages"])
            nodes[parent][1].append(n)
            nodes[n] = (rng.choice(["Pages", "Page", "Font"] if i < 5 else ["Pages"]), [])
        nodes[rng.choice([k for k in nodes if nodes[k][0] == "Pages"])][1].append(900 + i)  # missing
        held[i] = nodes
    held[10] = {1: ("Page", [])}
    held[11] = {1: ("Pages", [2, 1]), 2: ("Pages", [3]), 3: ("Pages", [2, 3, 4]), 4: ("Page", [])}  # cycles
    held[12] = {1: ("Pages", [2]), 2: ("Page", []), 5: ("Pages", [6]), 6: ("Pages", [5])}  # a circle that nothing leads to
    held[13] = {k: ("Pages", [k + 1]) for k in range(1, 30)}  # deeper than allowed
    objects, tops = tree_rows(spark, held)
    found = got(tree.page_tree(objects, tops, depth=16))
    for i, nodes in held.items():
        assert found[i] == ordered(by_kernel(nodes, 16)), i


def test_shared_nodes_are_expanded_once(spark):
    held = {1: {1: ("Pages", [2, 3]), 2: ("Pages", [4]), 3: ("Pages", [4, 2]), 4: ("Pages", [5]), 5: ("Page", [])}}
    found = got(tree.page_tree(*tree_rows(spark, held)))[1]
    assert found == ordered([(1, None, 0, "pages"), (2, 1, 1, "pages"), (3, 1, 1, "pages"), (4, 2, 2, "pages"), (4, 3, 2, "pages"), (2, 3, 2, "pages"), (5, 4, 3, "page")])


def test_a_tree_of_ten_thousand_levels(spark):
    n = 10_000
    held = {1: {k: ("Pages", [k + 1]) for k in range(1, n)} | {n: ("Page", [])}}
    rows = tree.page_tree(*tree_rows(spark, held), depth=20_000)
    assert rows.where("level = node - 1").count() == n
    assert [(r["node"], r["level"]) for r in rows.where("kind = 'page'").collect()] == [(n, n - 1)]


def test_no_trees(spark):
    objects, tops = tree_rows(spark, {1: {1: ("Pages", [])}})
    assert tree.page_tree(objects.where("false"), tops).collect()[0]["kind"] == "missing"
    assert tree.page_tree(objects, tops.where("false")).count() == 0


def faulty_files(rng):
    """Files of random objects, with contents, lists of contents, broken streams and what else goes wrong."""
    out = []
    for k in range(25):
        top = [(1, 0, o.dictionary(Type=o.name("Catalog"), **({"Pages": o.ref(2)} if k % 7 else {})), None)]
        kids = [o.ref(rng.randrange(3, 14)) for _ in range(4)]
        rest = [(2, 0, o.dictionary(Type=o.name("Pages" if k % 5 else "Page"), Kids=o.array(*dict.fromkeys(kids))), None)]
        for n in range(3, 12):
            what = rng.randrange(6)
            if what < 2:
                rest.append((n, 0, o.dictionary(Type=o.name("Page"), Contents=o.array(*[o.ref(rng.randrange(3, 14)) for _ in range(2)])), None))
            elif what == 2:
                rest.append((n, 0, o.dictionary(Contents=o.ref(rng.randrange(3, 14))), None))
            elif what == 3:
                rest.append((n, 0, o.array(o.ref(rng.randrange(n + 1, 14))), None))
            elif what == 4:
                rest.append((n, 0, o.dictionary(Length=o.num(3)), b"abc"))
            else:
                rest.append((n, 0, o.dictionary(Length=o.num(3), Filter=o.name("FlateDecode")), b"abc"))
        trailer = o.dictionary(**({"Root": o.ref(1 if k % 6 else 50)} if k % 4 else {}))
        out.append((k, files.build(top * (k != 9) + rest, trailer)))
    return [*out, (100, b""), (101, b"%PDF-1.7\n1 0 obj\n<<>>\nendobj\n")]


def test_faults_and_facts_equal_the_kernels(spark):
    rows = spark.createDataFrame(faulty_files(random.Random(3)), "file_id long, content binary")
    decoded, meta = decode.decoded_df(rows), decode.meta_df(rows)
    for single in (False, True):
        want = {tuple(r) for r in checks.validate_files(rows, single).collect()}
        assert {tuple(r) for r in checks.validate_df(decoded, meta, single).collect()} == want
    assert len({k for _, k, _, _ in want}) > 8
    plain = lambda df: {r["file_id"]: r.asDict(recursive=True) for r in df.collect()}
    assert plain(policy.facts_df(decoded, meta)) == plain(policy.facts_files(rows))


def test_strict_elements_end_the_job(spark):
    page = [(1, 0, o.dictionary(Type=o.name("Page")), None), (2, 0, o.dictionary(Type=o.name("Catalog")), None)]
    decoded = decode.decoded_df(spark.createDataFrame([(1, files.build(page, o.dictionary(Root=o.ref(2))))], "file_id long, content binary"))
    assert decode.elements_df(decoded).where("error = 'MediaBox'").count() == 1
    with pytest.raises(Exception, match="object 1: MediaBox"):
        decode.elements_df(decoded, strict=True).collect()


def test_region_files_are_read_in_parts(spark, monkeypatch):
    """No task makes or reads the whole file of a region; the tree is that of whole files."""
    from foliant import queries

    read, decoded = [], queries.decode.decoded_df
    monkeypatch.setattr(queries, "PART", 10)
    monkeypatch.setattr(queries.decode, "decoded_df", lambda df: read.append(df) or decoded(df))
    d = "/root/testdata/sf0.001"
    found = {(r.r_regionkey, r.level): r.n for r in queries.pdf_region_tree(spark, d).collect()}
    people = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.expr("c_nationkey = n_nationkey"))
    counts = people.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n_nationkey").alias("nations")).collect()
    assert all(found[r.n_regionkey, 0] == 1 and found[r.n_regionkey, 1] >= r.nations and found[r.n_regionkey, 2] == r.n for r in counts)
    assert max(r[0] for r in read[0].selectExpr("octet_length(content)").collect()) < 1100


def test_faults_read_files_once(spark):
    """Objects and trailers are read once each, however often the faults look at them."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    whole = spark.createDataFrame([(i, files.build(files.simple_page(b"BT ET"), o.dictionary(Root=o.ref(1)))) for i in range(4)], "file_id long, content binary")
    counted = whole.mapInArrow(passed, whole.schema)
    assert checks.validate_df(decode.decoded_df(counted), decode.meta_df(counted)).count() == 0
    assert read.value == 8
