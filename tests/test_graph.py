import pytest
from rows import pairs, post

from threadweave.operators import filters, graph, merge, redaction, timing

TEMPORAL = [post(0, text="@tweet i", author="a", at=(10, 5, 5)), post(1, [0], "@tweet i", "b", (10, 5, 35)), post(2, [0], "@tweet i", "a", (10, 5, 45)), post(3, [1], "@tweet i", "c", (12, 5, 45))]


def test_relatives(make):
    posts = make(*TEMPORAL)
    assert pairs(graph.parents(posts)) == {"1": {"0"}, "2": {"0"}, "3": {"1"}}
    assert pairs(graph.children(posts)) == {"0": {"1", "2"}, "1": {"3"}}
    assert pairs(graph.siblings(posts)) == {"1": {"2"}, "2": {"1"}}
    assert pairs(graph.siblings(posts, True))["0"] == {"0"}
    assert pairs(graph.ancestors(posts)) == {"1": {"0"}, "2": {"0"}, "3": {"0", "1"}}
    assert pairs(graph.descendants(posts)) == {"0": {"1", "2", "3"}, "1": {"3"}}
    assert pairs(graph.before_after(posts)) == {"1": {"0"}, "2": {"0", "1"}, "3": {"0", "1", "2"}}
    assert pairs(graph.before_after(posts, after=True)) == {"0": {"1", "2", "3"}, "1": {"2", "3"}, "2": {"3"}}


def test_time(make):
    posts = make(*TEMPORAL)
    assert [r["uid"] for r in timing.time_order(posts).orderBy("place").collect()] == ["0", "1", "2", "3"]
    assert timing.duration(posts).first()["duration"] == 7240.0
    assert {r["uid"]: r["response_time"] for r in timing.response_time(posts).collect()} == {"0": -1.0, "1": 30.0, "2": 40.0, "3": 7210.0}
    assert {r["uid"]: r["relative_age"] for r in timing.relative_age(posts).collect()} == {"0": 0.0, "1": 30.0, "2": 40.0, "3": 7240.0}
    assert [r["second"] for r in timing.time_series(posts).orderBy("place").collect()] == [0.0, 30.0, 40.0, 7240.0]


def test_missing_times(make):
    posts = make(post(0, at=(1, 0, 0), text="x"), post(1, [0], text="y"))
    assert timing.time_order(posts).count() == 0
    assert timing.duration(posts).first()["duration"] == -1.0
    assert {r["relative_age"] for r in timing.relative_age(posts).collect()} == {-1.0}
    assert timing.text_stream(posts).first()["texts"] == ["x", "y"]
    assert pairs(graph.before_after(posts))["1"] == {"0", "1"}
    assert "1" not in pairs(graph.before_after(posts, strict_nulls=True))


def test_depth_is_the_longest_path(make):
    posts = make(post(0), post(1, [0]), post(2, [1]), post(3, [0, 2]))
    assert {r["uid"]: r["depth"] for r in graph.depths(posts).collect()} == {"0": 0, "1": 1, "2": 2, "3": 3}
    diamond = make(post(0), post(1, [0]), post(2, [0]), post(3, [1, 2]))
    assert pairs(graph.ancestors(diamond))["3"] == {"0", "1", "2"}
    assert graph.tree_metrics(diamond).first().asDict() == {"convo_id": "c", "tree_depth": 2, "tree_width": 2, "tree_degree": 2}


def test_cycles_raise(make):
    for rows in ([post(0, [0])], [post(0, [1]), post(1, [0])]):
        with pytest.raises(Exception, match="own ancestor"):
            graph.depths(make(*rows)).collect()


def test_sources_and_flags(make):
    posts = make(post(0, ["gone"], author="a"), post(1, [0], author="a"), post(2, [0], author=None))
    assert [r["uid"] for r in graph.sources(posts).collect()] == ["0"]
    f = {r["uid"]: r for r in graph.flags(posts).collect()}
    assert not f["0"]["is_source"] and f["0"]["is_internal"] and f["1"]["is_leaf"]
    assert f["1"]["is_author_source_author"] and not f["2"]["is_author_source_author"]


def test_a_null_target_counts(make):
    posts = make(post(0, [None]))
    assert graph.degrees(posts).first()["out_degree"] == 1
    assert graph.sources(posts).count() == 1


def test_density(make):
    assert graph.density(make(post(0))).first()["density"] == 0.0
    assert graph.density(make(post(0, [1]), post(1, [0]), post(2))).first()["density"] == pytest.approx(1 / 3)


def test_segment_by_parity(make):
    posts = make(*[post(i, [i - 2] if i > 1 else []) for i in range(10)])
    parts = {}
    for r in graph.segment(posts).collect():
        parts.setdefault(r["convo_id"], set()).add(int(r["uid"]))
    assert parts == {"CONV_0": {0, 2, 4, 6, 8}, "CONV_1": {1, 3, 5, 7, 9}}


def test_derived_id_sorts_numbers(make):
    assert graph.derived_ids(make(post(10), post(9))).first()["derived_id"] == "CONV_9-10"


def test_filters(make):
    posts = make(post(0, text="long text", author="a", at=(1, 0, 0), tags=["x", "y"], lang="en"), post(1, text="t", at=(2, 0, 0), platform="Reddit"), post(2, text="no time", author="a", tags=["x"]))
    ids = lambda **k: {r["uid"] for r in filters.filter_posts(posts, **k).collect()}
    import datetime as dt

    assert ids() == {"0", "1", "2"}
    assert ids(min_chars=2) == {"0", "2"}
    assert ids(by_langs=["en"]) == {"0"} and ids(by_langs=[]) == {"0", "1", "2"}
    assert ids(before=dt.datetime(2020, 12, 1, 2)) == {"0"} and ids(after=dt.datetime(2020, 12, 1, 1)) == {"1"}
    assert ids(by_tags=["x", "y"]) == {"0"} and ids(by_tags=["x"]) == {"0", "2"}
    assert ids(by_platform=["Reddit"]) == {"1"} and ids(by_author="a") == {"0", "2"}
    assert filters.user_posts(posts, None).count() == 0
    assert filters.remove_from_set(posts.where("uid = 0"), "tags", "x").first()["tags"] == ["y"]
    with pytest.raises(Exception, match="isn't in tags"):
        filters.remove_from_set(posts, "tags", "y").collect()
    assert filters.add_to_set(posts.where("uid = 2"), "tags", "x").first()["tags"] == ["x"]


def test_merge(make):
    rows = [post(1, [5], "test this", None, (3, 0, 0), lang=None, seq=0), post(1, [5, 6], "longer text", "b", (2, 0, 0), lang="en", tags=["t"], seq=1), post(1, text="equal lengt", author="c", lang="de", seq=2)]
    m = merge.merge_posts(make(*rows)).collect()
    assert len(m) == 1
    r = m[0]
    assert (r["text"], r["author"], r["lang"], r["reply_to"], r["tags"], r["created_at"].hour) == ("longer text", "b", "en", ["5", "6"], ["t"], 2)
    again = merge.merge_posts(merge.merge_posts(make(*rows)))
    assert again.collect() == m


def test_union_takes_the_right_side_first(make):
    a, b = make(post(1, text="aa", author="a")), make(post(1, text="bb", author="b"), post(2))
    got = {r["uid"]: r for r in merge.union_conversations(a, b).collect()}
    assert got["1"]["text"] == "bb" and got["1"]["author"] == "b" and len(got) == 2


def test_redaction(make):
    posts = make(post(0, text="hi @bob and @bobby", author="a.+"), post(1, [0], "@bob! a.+", "bob"))
    got = {r["uid"]: (r["author"], r["text"]) for r in redaction.redact(posts).collect()}
    assert got["0"][0] == "USER0" and got["1"] == ("USER1", "@USER1! USER0")
    assert "@USER1" in got["0"][1] and "bob " not in got["0"][1]
    assert {r["text"] for r in redaction.redact(make(*TEMPORAL[:1])).collect()} == {"@USER1 i"}
