from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup

SPACE = " \t\n\r\x0b\x0c"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least):
    owners = defaultdict(set)
    rank = lambda i: (i is None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                owners[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 16, 1 << 22])
def test_against_brute_force(spark, odd, odd_rows, bits):
    shared = ["A line that many hold", "  a LINE that many hold\t", "short", "éééééééééé", "ééééé", "a line that many hold\r"]
    more = [(1000 + i, "\n".join([shared[i % 6], f"own {i}", shared[(i * 5) % 6], shared[i % 6]]), "x", "y", 1) for i in range(40)]
    docs = odd.union(spark.createDataFrame(more, odd.schema)).withColumns({"n_lines": F.lit("clash"), "k1": F.lit(0)})
    rows = [(r[0], r[1]) for r in odd_rows + more]
    found = line_dedup.drop_repeated_lines(docs, filter_bits=bits)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == brute(rows, 10)


def test_empty(empty):
    assert line_dedup.drop_repeated_lines(empty, filter_bits=1 << 20).collect() == []
