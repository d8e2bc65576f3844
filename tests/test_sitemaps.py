"""Sitemaps of one and two levels."""

from tidemark.sources import sitemaps

BASE = "https://x.ex"


def listed(*urls):
    return "<urlset>" + "".join(f"<url><loc>\n {u} </loc></url>" for u in urls) + "</urlset>"


def pages(spark, documents, starts):
    docs = spark.createDataFrame([(s, u, p, 0) for s, u, p in documents], "source_id long, url string, payload string, nth int")
    found = sitemaps.sitemap_pages(docs, spark.createDataFrame(starts, "source_id long, url string"))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.source_id, r.nth)):
        out.setdefault(r.source_id, []).append(r.url)
    return out


def test_levels_order_and_choices(spark):
    start = f"{BASE}/sitemap.xml"
    children = [f"{BASE}/jobs-{k:02}.xml" for k in range(12)]
    others = [f"{BASE}/part-{k}.xml" for k in range(8)]
    documents = [
        # an index with job sitemaps: ten of them, in order, not the blog
        (1, start, listed(f"{BASE}/blog.xml", *children)), (1, f"{BASE}/blog.xml", listed(f"{BASE}/post")),
        *((1, c, listed(f"{BASE}/vacature/{k}", f"{BASE}/about/{k}", f"{BASE}/vacature/{k}/apply", f"{BASE}/vacature/{k}?a=1&amp;b=2")) for k, c in enumerate(children)),
        # an index without: its first five; a child without job pages gives all of its pages, a nested index is not followed
        (2, start, listed(*others)), (2, others[0], listed(f"{BASE}/a", f"{BASE}/b")), (2, others[1], listed(f"{BASE}/deep.xml")), (2, f"{BASE}/deep.xml", listed(f"{BASE}/job/9")), (2, others[5], listed(f"{BASE}/job/5")),
        # one level; repeats once; a missing start, a null payload, an empty list
        (3, start, listed(f"{BASE}/job/1", f"{BASE}/job/2", f"{BASE}/job/1", f"{BASE}/nl/solliciteren/")), (4, start, None), (5, start, listed()),
    ]
    got = pages(spark, documents, [(k, start) for k in range(1, 7)])
    assert got[1] == [u for k in range(10) for u in (f"{BASE}/vacature/{k}", f"{BASE}/vacature/{k}?a=1&b=2")]
    assert got[2] == [f"{BASE}/a", f"{BASE}/b", f"{BASE}/deep.xml"]
    assert got[3] == [f"{BASE}/job/1", f"{BASE}/job/2"]
    assert set(got) == {1, 2, 3}


def test_large_sources_keep_addresses_at_home(spark):
    start = f"{BASE}/sitemap.xml"
    urls = [f"{BASE}/job/{('delft', 'paris', 'x-nl-y', 'the-netherlands')[k % 4]}/{k}" for k in range(2501)]
    got = pages(spark, [(1, start, listed(*urls)), (2, start, listed(*urls[:2500]))], [(1, start), (2, start)])
    assert got[1] == [u for u in urls if "paris" not in u] and got[2] == urls[:2500]


def test_pages_to_read_leave_known_ones_out(spark):
    found = spark.createDataFrame([(1, k, f"u{k}") for k in range(1, 8)], "source_id long, nth int, url string")
    known = spark.createDataFrame([(1, "u2"), (1, "u2"), (2, "u3"), (None, None)], "source_id long, url string")
    assert sorted(r.nth for r in sitemaps.to_read(found, known, most=3).collect()) == [1, 3, 4]
    assert sitemaps.sitemap_pages(spark.createDataFrame([], "source_id long, url string, payload string"), spark.createDataFrame([], "source_id long, url string")).count() == 0
