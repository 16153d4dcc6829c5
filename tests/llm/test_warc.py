from gridspark.llm.warc_revisit import PERMITTED, canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, time long, kind string, digest string, headers map<string,string>"


def canonical(spark, urls):
    return [r.c for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i").select(canonical_url("url").alias("c")).collect()]


def test_canonical_urls(spark):
    urls = ["http://WWW.A.com:80/x/#f", "https://a.com/x", "a.com/x?", "https://a.com:443/x?b=2&a=1", "http://a.com/x/?a=1&&b=2", "http://a.com/X", "", None]
    assert canonical(spark, urls) == ["a.com/x", "a.com/x", "a.com/x", "a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "a.com/X", "", None]


def brute(rows, key):
    out = {}
    for n, (i, url, time, kind, digest, headers) in enumerate(rows):
        headers = headers or {}
        if kind == "response":
            out.setdefault(i, []).append(("response", i, headers))
            continue
        before = [r for r in rows if r[3] == "response" and url is not None and time is not None and r[1] is not None and r[2] is not None]
        before = [r for r in before if key[r[1]] == key[url] and (r[2], r[0]) < (time, i)]
        if not before:
            out.setdefault(i, []).append(("no_source", None, headers))
            continue
        s = max(before, key=lambda r: (r[2], r[0]))
        old = s[5] or {}
        tag, old_tag = (h.get("etag", "").removeprefix("W/") or None for h in (headers, old))
        date, old_date = headers.get("last-modified"), old.get("last-modified")
        if digest and s[4] and digest != s[4]:
            status = "digest_differs"
        elif tag and old_tag and tag != old_tag:
            status = "etag_differs"
        elif not (tag and old_tag) and date and old_date and date != old_date:
            status = "date_differs"
        else:
            status = "resolved" if digest and s[4] or tag and old_tag or date and old_date else "unchecked"
        good = status in ("resolved", "unchecked")
        out.setdefault(i, []).append((status, s[0] if good else None, old | {k: v for k, v in headers.items() if k in PERMITTED} if good else headers))
    return out


def rows_of(n):
    rows = []
    for i in range(n):
        url = "http://hot.example/" if i % 3 else f"https://WWW.site{i % 7}.example/p?b=1&a={i % 2}"
        kind = "response" if i % 4 == 0 else "revisit"
        headers = {"date": str(i), "set-cookie": str(i), "content-type": "t"}
        if i % 5 != 1:
            headers["etag"] = f'W/"{i % 3}"' if i % 2 else f'"{i % 4}"'
        if i % 3 != 1:
            headers["last-modified"] = str(i % 2)
        rows.append((i, url, (i * 37) % 50, kind, [None, "d0", "d1"][i % 3] if i % 5 else "d0", headers if i % 11 else None))
    rows += [(1000, None, 5, "revisit", "d0", None), (1001, "http://hot.example/", None, "revisit", "d0", None), (1002, None, 1, "response", "d0", None)]
    return rows


def test_matches_brute_force_over_many_ranges(spark):
    rows = rows_of(240)
    urls = sorted({r[1] for r in rows if r[1]})
    key = dict(zip(urls, canonical(spark, urls), strict=True))
    want = brute(rows, key)
    for partitions in (1, 9):
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS source", "'y' AS status")
        got = resolve_revisits(df, partitions).collect()
        assert {r.record_id: [(r.status, r.source_id, r.headers)] for r in got} == want
        assert {r[0] for g in want.values() for r in g} >= {"response", "resolved", "unchecked", "no_source", "digest_differs", "etag_differs", "date_differs"}


def test_repeated_rows_and_empty_table(spark):
    row = (2, "http://a.b/", 9, "revisit", None, {"etag": '"1"'})
    df = spark.createDataFrame([(1, "http://a.b", 9, "response", "d", {"etag": 'W/"1"', "set-cookie": "s"}), row, row], SCHEMA)
    got = [(r.source_id, r.headers) for r in resolve_revisits(df).filter("kind = 'revisit'").collect()]
    assert got == [(1, {"etag": '"1"', "set-cookie": "s"})] * 2
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
