"""Chunks, spans, renames, deltas, forms and plans against brute force, and queries against their SQL."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import cycle
from pathlib import Path

import duckdb
import pytest

from commitlake.functions import forms, spans
from commitlake.operators import renames, textdiff, trees
from commitlake.plans import catalog, contents
from commitlake.sources.views import Repository

SF = "/root/testdata/sf0.001"
NAMES = [
    "t03_status_of_all", "t17_applicable_to_all", "t18_applied_to_all", "k06_stage_of_all", "k13_checkout", "k08_commit_outcomes", "k08_commit_edges", "k08_commit_refs", "k09_ref_requests", "m03_merge_plans",
    "m07_rebase_plans", "m08_stash_records", "m11_publish", "d05_inserted_lines", "d06_kept_lines", "d10_numstat_balance", "c04_decoded", "o04_commit_fields", "o05_projected_roots", "o06_tree_files", "f02_forms", "q27_text_query", "z10_status_lines",
]


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, name):
    from commitlake import registry

    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = registry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()
    assert want and Counter(tuple(r) for r in got.collect()) == Counter(want)


def sample(length):
    return bytes((i * 131 + i // 17 * 29 + i // 4093 * 47) % 256 for i in range(length))


def test_chunk_boundaries():
    data, sizes = sample(100_000), (512, 2048, 8192)
    want = [2302, 10494, 16493, 18669, 24652, 26828, 35020, 43212, 51404, 59596, 61818, 63994, 66307, 68483, 76675, 82130, 84306, 90289, 92465]
    assert spans.chunk_ends(data, sizes)[0] == want
    for steps in ([1, 7, 31, 1024, 3, 8192], [4096]):
        at, state, found = 0, (b"", 0), []
        for step in cycle(steps):
            if at >= len(data):
                break
            ends, state = spans.chunk_ends(data[at : at + step], sizes, state)
            found += [at + e for e in ends]
            at += step
        assert found == want
    parts = {data[a : a + n] for a, n in spans.chunks(data, sizes)}
    moved = data[:50_000] + b"inserted" + data[50_000:]
    assert sum(moved[a : a + n] in parts for a, n in spans.chunks(moved, sizes)) > 0.8 * len(parts)
    assert spans.chunks(b"", sizes) == [] and spans.chunks(b"abc", sizes) == [(0, 3)]
    with pytest.raises(ValueError):
        spans.chunks(data, (8, 16, 32))


def brute_spans(data):
    text, counts, a, b, n, i = 0 not in data[:8000], Counter(), 0, 0, 0, 0
    while i < len(data):
        c, i = data[i], i + 1
        if text and c == 13 and data[i : i + 1] == b"\n":
            continue
        a, b = ((a << 7 & 0xFFFFFFFF) ^ b >> 25) + c & 0xFFFFFFFF, (b << 7 & 0xFFFFFFFF) ^ a >> 25
        n += 1
        if n == 64 or c == 10:
            counts[(a + b * 97 & 0xFFFFFFFF) % 107927] += n
            a = b = n = 0
    if n:
        counts[(a + b * 97 & 0xFFFFFFFF) % 107927] += n
    return counts


def test_spans():
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choices([10, 13, 65, 66, 67, 200, rng.choice([0, 68])], k=rng.randrange(300)))
        kinds, counts = spans.span_counts(data)
        assert dict(zip(kinds.tolist(), counts.tolist())) == brute_spans(data)


def brute_score(a, b, least):
    x, y, most = brute_spans(a), brute_spans(b), max(len(a), len(b))
    if not most or most * (100 - least) < (most - min(len(a), len(b))) * 100:
        return 0
    return sum(min(n, y[k]) for k, n in x.items()) * 100 // most


def test_similar_renames(spark):
    """Over all commits, against a loop over every pair of deleted and added files."""
    r = Repository(spark, SF)
    text = {x["content_id"]: x["text"].encode() for x in contents.overlapping(r).collect()}
    changed = trees.commit_changes(r.tree, r.commits, r.edges)
    exact = {(x["commit_id"], p) for x in trees.exact_renames(changed, ["commit_id"]).collect() for p in (x["old_path"], x["new_path"])}
    sides = defaultdict(lambda: ([], []))
    for x in trees.flat(changed).filter("kind <> 'modified'").collect():
        if (x["commit_id"], x["path"]) not in exact:
            sides[x["commit_id"]][x["kind"] == "added"].append((x["path"], x["new_content"] if x["old_content"] is None else x["old_content"]))
    want = set()
    for commit, (gone, come) in sides.items():
        pairs = [(-brute_score(text[c], text[e], 50), p.split("/")[-1] != q.split("/")[-1], p, q) for p, c in gone for q, e in come if c in text and e in text]
        old, new = set(), set()
        for score, _, p, q in sorted(x for x in pairs if -x[0] >= renames.THRESHOLD):
            if p not in old and q not in new:
                old.add(p), new.add(q), want.add((commit, p, q, -score))
    got = {tuple(x) for x in contents.t11_similar_renames(r).select("commit_id", "old_path", "new_path", "score").collect()}
    assert want and got == want


def test_line_deltas():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("\n".join(rng.choices("abc", k=rng.randrange(9))) + rng.choice(["", "\n"]) for _ in range(2))
        assert textdiff.apply_line_delta(a, textdiff.line_delta(a, b)) == b


def test_forms():
    found = forms.split_forms('(ns a)\n; c\n(def s "x)\\"(")\n#_(skip me)\n[1 2]\n(f \\( (g) \'(h))\n(open')
    assert [(f["kind"], f["name"], f["line"]) for f in found] == [("ns", "a", 1), ("def", "s", 2), (None, None, 5), ("f", None, 6)]
    assert found[3]["calls"] == ["f", "g", "h"] and found[1]["text"].startswith("; c\n") and forms.split_forms("") == [] and forms.split_forms(")") == []


def test_scores_of_pairs_in_blocks(spark, monkeypatch):
    """Many small bins and contents in many pairs give every pair's score; no pair meets its contents in an exchange."""
    from commitlake.operators import pairing

    monkeypatch.setattr(pairing, "BLOCK_PAIRS", 40)
    rng = random.Random(4)
    texts = {i: "".join(f"line {rng.randrange(12)} of é\r\n" for _ in range(rng.randrange(9))) for i in range(30)} | {30: ""}
    pairs = [(d, a, b) for d in range(2) for a in texts for b in texts] + [(0, 3, 99), (0, None, 3)]
    given = spark.createDataFrame(pairs, "d int, old_content long, new_content long")
    blobs = spark.createDataFrame(list(texts.items()), "content_id long, text string")
    for least in (0, 50):
        got = renames.scores(given, blobs, least)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
        want = {(d, a, b): brute_score(texts[a].encode(), texts[b].encode(), least) for d, a, b in pairs if a in texts and b in texts}
        assert {tuple(r)[:3]: r["score"] for r in got.collect()} == {k: n for k, n in want.items() if n >= least}


def test_spans_of_many_at_once():
    rng = random.Random(7)
    datas = [bytes(rng.choices([10, 13, 65, 66, rng.choice([0, 68])], k=rng.randrange(200))) for _ in range(50)] + [b"", b""]
    ends, kinds, counts = spans.span_counts_of(datas)
    for data, a, b in zip(datas, [0, *ends.tolist()], ends.tolist()):
        assert dict(zip(kinds[a:b].tolist(), counts[a:b].tolist())) == brute_spans(data)


def test_scores_of_texts_in_rows(spark):
    rows = [(1, "a\nb\nc\n", "a\nc\n"), (2, "", ""), (3, None, "a"), (4, "x" * 200, "x" * 150 + "y" * 50)]
    got = {r["content_id"]: r["score"] for r in renames.text_scores(spark.createDataFrame(rows, "content_id long, old_text string, new_text string"), 0).collect()}
    assert got == {i: brute_score(a.encode(), b.encode(), 0) for i, a, b in rows if a is not None}


def test_files_without_a_side_are_dealt(spark):
    """Added and deleted files have no content on one side; a join on that side alone puts them all in one task."""
    plan = catalog.QUERIES["h02_pickaxe"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 2 and all("spread" in line for line in plan.splitlines() if "LeftOuter" in line)


def test_counts_of_diffs(spark):
    """The numbers of the edits, without the edits: the plan has no array of them."""
    rng = random.Random(6)
    rows = [(i, *("\n".join(rng.choices("abc", k=rng.randrange(9))) + rng.choice(["", "\n"]) for _ in range(2))) for i in range(40)] + [(40, None, "a"), (41, "", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string").select("id", textdiff.diff_counts("a", "b").alias("n")).select("id", "n.*")
    for r, (_, a, b) in zip(sorted(df.collect()), rows):
        edits = textdiff.diff_text(a or "", b or "")
        assert tuple(r)[1:] == tuple(sum(e[n] for e in edits if e[0] == op) for op, n in (("insert", 4), ("delete", 2), ("equal", 2)))
    for name in ("d05_inserted_lines", "d06_kept_lines"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "diff_counts" in plan and "diff_edits" not in plan and "Join" not in plan


def test_versions_are_stored_without_a_join(spark):
    """Versions of a text meet in its row, and deltas are encoded once; a delta may have a full base of any depth."""
    from commitlake.operators import contents as operator

    assert "Join" not in contents.stored(Repository(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    rows = [("a", "full", None, 0, "x\ny\n"), ("b", "line-delta", "a", 2, textdiff.line_delta("x\ny\n", "x\nz\n")), ("c", "line-delta", "b", 3, textdiff.line_delta("x\nz\n", "z\n"))]
    seen = spark.sparkContext.accumulator(0)

    def once(payload):
        seen.add(1)
        return payload

    from pyspark.sql import functions as F

    given = spark.createDataFrame(rows, "id string, kind string, base string, depth int, payload string").withColumn("payload", F.udf(once, "string")("payload"))
    got = {r["id"]: r["text"] for r in operator.decoded(given).collect()}
    assert got == {"a": "x\ny\n", "b": "x\nz\n", "c": "z\n"} and seen.value == 3


@pytest.mark.parametrize("name", ["d07_hunks", "d08_unified", "d10_numstat_balance"])
def test_texts_of_pairs_meet_in_blocks(spark, name):
    """No join carries the texts of a pair."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "old_text" not in plan and "new_text" not in plan


def test_unified_of_pairs(spark):
    from commitlake.operators import pairing
    from pyspark.sql import types as T

    texts = [(1, "a\nb\n"), (2, "a\nc"), (3, None)]
    pairs = [(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)]
    schema = T.StructType([T.StructField("old_content", T.LongType()), T.StructField("new_content", T.LongType()), T.StructField("patch", T.StringType())])
    contents_ = spark.createDataFrame(texts, "content_id long, text string").selectExpr("*", "8 AS size")
    got = pairing.in_blocks(spark.createDataFrame(pairs, "old_content long, new_content long"), contents_, "size", textdiff.of_pairs(textdiff.unified, "patch", T.StringType()), schema, 2)
    known = dict(texts)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {(a, b): textdiff.unified(known[a] or "", known[b] or "") for a, b in pairs if a in known}


def common_lines(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        before = row
    return before[-1]


def test_scripts_beyond_the_trace(monkeypatch):
    """However few cells a trace may have, a script is a shortest one, and the same as with the trace where that fits."""
    monkeypatch.setattr(textdiff, "_OFTEN", 3)
    rng = random.Random(8)
    for k in range(1500):
        a, b = (rng.choices("abcdefghijklmnop"[: rng.randrange(1, 17)], k=rng.randrange(30)) for _ in range(2))
        if k % 3 == 0:
            b = [x if rng.random() < 0.8 else "q" for x in a] + b[:3]
        most = common_lines(a, b)
        for budget in (0, 1, 20, 100):
            script, back = textdiff.edits(a, b, budget), []
            for op, i, n, j, m in script:
                assert op != "equal" or a[i : i + n] == b[j : j + m]
                back += {"equal": a[i : i + n], "insert": b[j : j + m], "delete": []}[op]
            assert back == b and sum(e[2] for e in script if e[0] == "equal") == most
            if (len(a) + len(b) - 2 * most + 1) ** 2 <= budget:
                assert script == textdiff.edits(a, b)


def long_texts(folder):
    """A folder with documents of so many lines that a trace of their edits outgrows its budget."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(9)
    texts = ["\n".join(f"line {i}" for i in range(13_001)), "\n".join(rng.choices("abcdefgh", k=13_001)), "a\nb\nc\nd\ne"]
    pq.write_table(pa.table({"doc_id": pa.array(range(3), pa.int64()), "text": texts}), folder / "documents.parquet")
    return folder


def like_sql(spark, name, folder):
    """Whether a query equals its SQL over the tables of ``folder``, the others as they are."""
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        own = Path(folder) / f.name
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{own if own.exists() else f}'")
    got = catalog.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()
    return bool(want) and Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_inserted_lines_of_long_texts(spark, tmp_path):
    assert like_sql(spark, "d05_inserted_lines", long_texts(tmp_path))


def test_kept_lines_of_long_texts(spark, tmp_path):
    assert like_sql(spark, "d06_kept_lines", long_texts(tmp_path))


@pytest.mark.parametrize("ids", ["long", "string"])
def test_contents_are_sent_once_however_many_bins(spark, ids):
    """Blocks read their bins where they lie: no content is copied for each of them, and the pairs of a block come in order."""
    import pyarrow as pa
    from commitlake.operators import pairing

    rng = random.Random(11)
    texts = [(k - 5, rng.choice("abc")) for k in range(60)]
    pairs = [(rng.randrange(-7, 60), rng.randrange(-7, 60)) for _ in range(400)]

    def named(left, right):
        at = dict(zip(right.column("content_id").to_pylist(), right.column("text").to_pylist()))
        ends = [(a, b) for a, b in zip(left.column("old_content").to_pylist(), left.column("new_content").to_pylist())]
        assert ends == sorted(ends)
        yield pa.RecordBatch.from_arrays([pa.array([at.get(a, "-") + at.get(b, "-") + f" {a} {b}" for a, b in ends])], ["both"])

    given = spark.createDataFrame(pairs, "old_content long, new_content long").selectExpr(*[f"CAST({c} AS {ids}) AS {c}" for c in ("old_content", "new_content")])
    contents_ = spark.createDataFrame(texts, "content_id long, text string").selectExpr(f"CAST(content_id AS {ids}) AS content_id", "text", "1 AS size")
    known = dict(texts)
    for bins in (1, 2, 9):
        got = pairing.in_blocks(given, contents_, "size", named, "both string", bins)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("CartesianProduct") == 1
        assert Counter(r[0] for r in got.collect()) == Counter(known.get(a, "-") + known.get(b, "-") + f" {a} {b}" for a, b in pairs)


def test_results_of_long_texts_come_in_small_batches(monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T

    monkeypatch.setattr(textdiff, "_CHARACTERS", 10)
    left = pa.table({"old_content": [1, 1, 3, 4, 2], "new_content": [2, 3, 9, 1, 2]})
    right = pa.table({"content_id": [1, 2, 3, 4], "text": ["a\n", "abcdefghijk\n", None, ""]})
    got = list(textdiff.of_pairs(textdiff.unified, "patch", T.StringType())(left, right))
    assert [b.num_rows for b in got] == [1, 3] and pa.Table.from_batches(got).column("new_content").to_pylist() == [2, 3, 1, 2]


def applied(old, patch):
    """The text that a unified patch makes of ``old``, and how many lines it takes out and puts in."""
    lines, out, at, signs = old.splitlines(keepends=True), [], 0, Counter()
    body = patch.splitlines(keepends=True)[2:]
    for k, line in enumerate(body):
        if line.startswith("@@"):
            start, count = (line.split()[1][1:] + ",1").split(",")[:2]
            until = int(start) - (count != "0")
            out, at = out + lines[at:until], until
            continue
        text = line[1:-1] if body[k + 1 : k + 2] and body[k + 1].startswith("\\") else line[1:]
        signs[line[0]] += 1
        if line[0] in " -":
            assert lines[at] == text
            at += 1
        if line[0] in " +":
            out.append(text)
    return "".join(out + lines[at:]), signs["-"], signs["+"]


def test_unified_of_all_modified_pairs(spark, tmp_path):
    """Long texts have a shortest patch, and pairs without a text are told from pairs with one."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for f in Path(SF).glob("*.parquet"):
        (tmp_path / f.name).symlink_to(f)
    (tmp_path / "documents.parquet").unlink()
    lines = [f"line {i}" for i in range(9_000)]
    texts = {0: "\n".join(lines), 1: "\n".join(x for i, x in enumerate(lines) if i % 2), 3: "", 4: "line 1\nline 3", 5: None}
    pq.write_table(pa.table({"doc_id": pa.array(texts, pa.int64()), "text": list(texts.values())}), tmp_path / "documents.parquet")
    got = contents.d08_unified(Repository(spark, str(tmp_path))).collect()
    flat = trees.flat(catalog.changed(Repository(spark, str(tmp_path)))).filter("kind = 'modified'").select("old_content", "new_content")
    assert Counter((r[0], r[1]) for r in got) == Counter(tuple(r) for r in flat.distinct().collect())
    assert {k for r in got for k in r[:2]} >= {0, 1, 2, 3, 4, 5}
    for a, b, patch in got:
        assert (patch is None) == (a not in texts or b not in texts)
        if patch:
            assert applied(texts[a] or "", patch)[0] == (texts[b] or "")
    # The last lines of 0 and 1 are equal, and so is every line of 1.
    found = {(a, b): patch for a, b, patch in got}
    assert (0, 1) in found and (1, 0) in found
    assert applied(texts[0], found[0, 1])[1:] == (4_500, 0) and applied(texts[1], found[1, 0])[1:] == (0, 4_500)


def test_blocks_without_contents(spark):
    from commitlake.operators import pairing
    from pyspark.sql import types as T

    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "old_content long, new_content long")
    none = spark.createDataFrame([], "content_id long, text string, size int")
    run = textdiff.of_pairs(textdiff.unified, "patch", T.StringType(), lacking=True)
    got = pairing.in_blocks(pairs, none, "size", run, "old_content long, new_content long, patch string", 3)
    assert Counter(tuple(r) for r in got.collect()) == Counter((a, b, None) for a in range(4) for b in range(4))


def test_texts_are_found_by_a_table_of_known_size(spark, monkeypatch):
    """The ids of modified pairs are written, so that Spark sees how few they are and need not deal all texts to join them."""
    written, write = {}, contents.materialize
    monkeypatch.setattr(contents, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    ids = {c for r in contents.d08_unified(Repository(spark, SF)).collect() for c in r[:2]}
    assert sorted(r[0] for r in written["modified-contents"].collect()) == sorted(ids)
    assert {r["content_id"] for r in written["modified-texts"].collect()} == ids
