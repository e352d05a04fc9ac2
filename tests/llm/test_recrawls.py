"""One page_id with several payloads: only the payload that has a copy elsewhere becomes a revisit."""

import hashlib

from wavelake.llm import warc


def test_payloads_of_one_id(spark):
    a, b, c = ("abc"[k] * (1200 + k) for k in range(3))
    rows = [(7, "u", a), (7, "u", b), (9, "u", a), (9, "v", c), (7, "w", "short"), (11, "u", b), (7, "x", c)]
    last = {}
    for i, _, h in rows:
        last[h] = max(i, last.get(h, i))
    want = sorted((i, hashlib.sha1(h.encode()).hexdigest(), "revisit" if len(h) >= 1000 and last[h] != i else "response", last[h] if len(h) >= 1000 and last[h] != i else -1) for i, _, h in rows)
    got = warc.archived(spark.createDataFrame(rows[:], "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want
    got = warc.archived(spark.createDataFrame(rows[:3], "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(7, "response", 0), (7, "revisit", 9), (9, "response", 0)]
