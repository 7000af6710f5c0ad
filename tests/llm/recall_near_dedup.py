"""python tests/llm/recall_near_dedup.py SF_DIR: how many exact links, and how many documents' classes, op9 finds.

All pairs that can be linked are aligned: those that share one of the rarest runs that a link must share.
"""

import os
import sys
import tempfile
from collections import Counter, defaultdict
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT


def exact_links(texts: list[str]) -> list[tuple[int, int]]:
    import pyarrow as pa

    from tessera.llm import near_dedup, textnp

    runs, firsts = near_dedup.runs_of(*textnp.utf8(pa.array(texts, pa.large_string())))
    own = [runs[x:y] for x, y in zip(firsts[:-1], firsts[1:], strict=True)]
    seen = [[(x, n) for x, n in _numbered(r.tolist())] for r in own]
    held = Counter(t for s in seen for t in s)
    posts, out = defaultdict(list), set()
    for i, s in enumerate(seen):
        keep = len(s) - -(-4 * len(s) // 5) + 1
        near = set()
        for t in sorted(s, key=lambda t: (held[t], t))[:keep] if s else ():
            near.update(posts[t])
            posts[t].append(i)
        out.update((j, i) for j in near if near_dedup.linked(own[j], own[i])[0])
    return sorted(out)


def _numbered(values):
    count = Counter()
    for v in values:
        yield v, count[v]
        count[v] += 1


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession

    from tessera.llm import near_dedup
    from tessera.session import ship_package

    shared = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    texts = sorted({r.text or "" for r in rows})
    links = exact_links(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    number = {t: i for i, t in enumerate(texts)}
    one = {number[r.text or ""]: found[r.doc_id] for r in rows}
    kept = sum(one[a] == one[b] for a, b in links)
    groups = defaultdict(list)
    for r in rows:
        groups[find(number[r.text or ""])].append(r.doc_id)
    same = sum(len(ids) for ids in groups.values() if {found[i] for i in ids} == {min(ids)})
    print(f"{sf_dir}: {len(texts)} different texts, {len(links)} links of which {kept} found ({kept / max(len(links), 1):.6f}); {same} of {len(rows)} documents in their exact class")


if __name__ == "__main__":
    main(sys.argv[1])
