"""Clusters of related rules against a plain version, and the manifest that a stream keeps."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from lintlake import streaming
from lintlake.operators import remediation


def plain_tasks(rows, related):
    """Finding by finding, in order: one that no cluster has takes all that are related to it."""
    pairs = {p for a, b in related for p in ((a, b), (b, a))}
    used, tasks = set(), Counter()
    for rule, mark, _, at, weight in rows:
        if mark in used:
            continue
        cluster = [r for r in rows if r[1] == mark or ((r[0], rule) in pairs and r[0] != rule)]
        if len(cluster) > 1:
            used |= {r[1] for r in cluster}
            top = max(cluster, key=lambda r: (r[4], -r[3]))
            tasks["by_related", top[0], len(cluster)] += 1
    rest = [r for r in rows if r[1] not in used]
    by_file = defaultdict(list)
    for r in rest:
        by_file[r[2], r[0]].append(r)
    for (file, rule), rs in by_file.items():
        if len(rs) > 1:
            tasks["by_file", f"{file}::{rule}", len(rs)] += 1
            rest = [r for r in rest if r not in rs]
    by_rule = defaultdict(list)
    for r in rest:
        by_rule[r[0]].append(r)
    for rule, rs in by_rule.items():
        tasks[("by_rule", rule, len(rs)) if len(rs) > 1 else ("singleton", rs[0][1], 1)] += 1
    return tasks


@pytest.mark.parametrize("seed", range(4))
def test_related_tasks(spark, seed):
    r = random.Random(seed)
    rows = [(f"r{r.randrange(9)}", f"f{i}", f"file{r.randrange(4)}", i, r.choice([1, 5, 10])) for i in range(r.choice([12, 40]))]
    related = [(f"r{r.randrange(12)}", f"r{r.randrange(12)}") for _ in range(r.choice([0, 4, 8]))]
    findings = spark.createDataFrame(rows, "rule_id string, fingerprint string, file string, ord int, severity_weight int")
    got = remediation.related_tasks(findings, spark.createDataFrame(related, "rule_id string, other string")).collect()
    assert Counter((x.task_kind, x.task_key, x.n) for x in got) == plain_tasks(rows, related)


def test_manifest_in_buckets(spark, tmp_path):
    source, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")

    def put(rows):
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        streaming.manifest_buckets(streaming.document_stream(spark, source), manifest, str(tmp_path / checkpoint), buckets=8).awaitTermination()
        return {r.path: r.hash for r in streaming.load_manifest(spark, manifest).collect()}

    files = lambda: {str(p) for p in Path(manifest).rglob("*.parquet")}
    put([(i, f"t{i}") for i in range(40)])
    first = run("c1")
    assert len(first) == 40
    digest = streaming.tree_digest(streaming.load_manifest(spark, manifest)).first()
    assert digest.n_files == 40
    before = files()
    put([(3, "new"), (100, None)])
    second = run("c1")
    assert {k for k in second if second[k] != first.get(k)} == {"doc/3", "doc/100"}
    assert len(second) == 41
    assert len(files() - before) <= 2 and before <= files()  # only the buckets of two paths
    assert streaming.tree_digest(streaming.load_manifest(spark, manifest)).first().digest != digest.digest
    assert run("c1") == second
    put([(3, "t3")])
    assert run("c1") == {**second, "doc/3": first["doc/3"]}
    again = run("another checkpoint")  # all files anew: of each path some content that it had, and no path is lost
    assert again.keys() == second.keys()
