import json

import pytest
from rows import post

from threadweave.sources import raw, readers

TWEET = {
    "created_at": "Tue Dec 01 12:54:12 +0000 2020", "id": 123456789101112131415, "full_text": "see t.co/a and t.co/m", "lang": "en", "user": {"screen_name": "ap"},
    "in_reply_to_status_id": None, "quoted_status_id": 7, "entities": {"hashtags": [], "urls": [{"url": "t.co/a", "expanded_url": "https://a.b/?x=(1)"}], "media": [{"url": "t.co/m", "display_url": "pic"}]},
    "quoted_status": {"id": 7, "text": "quoted", "user": {"screen_name": "q"}},
}


def test_tweet():
    quoted, own = raw.tweet(TWEET)
    assert quoted[:3] == ("7", "quoted", "q")
    assert own[0] == "123456789101112131415" and own[1] == "see https://a.b/?x=(1) and pic" and own[4] == [None, "7"]
    assert raw.tweet({"id": 1, "text": ""}) == []
    with pytest.raises(KeyError):
        raw.tweet({"id": 1, "odd": 2})


def test_facebook_shapes():
    assert raw.facebook({"id": "1_2", "type": "video", "name": "n", "message": "m", "created_time": "2020-01-01T00:00:00+0000"}, "post")[0][1] == "n m"
    replies = {"data": [{"id": "r", "message": "x", "replies": {"data": [{"id": "rr", "message": "y"}]}}]}
    rows = raw.facebook(replies, "replies", "p")
    assert [(r[0], r[4]) for r in rows] == [("rr", ["r"]), ("r", ["p"])]
    assert raw.facebook([], "comments") == []
    with pytest.raises(ValueError):
        raw.facebook({}, "other")
    with pytest.raises(KeyError):
        raw.facebook([{"odd": 1}], "comments")


def test_reddit_shapes():
    thing = {"kind": "Listing", "data": {"children": [{"kind": "t3", "data": {"id": "c1", "title": "title:", "selftext": "text", "author": "a", "created_utc": 9999999999.0, "parent_id": "t3_c0"}}]}}
    (row,) = raw.reddit(thing)
    assert row[:5] == ("c1", "title:\ntext", "a", 9999999999.0, ["c0"])
    assert raw.reddit({"id": "_"}) == []
    with pytest.raises(KeyError):
        raw.reddit({"id": "x", "odd": 1})
    flat = {"id": "k", "author": "a", "created_utc": "5", "subreddit": "b", "type": "comment", "body": "t", "parent_id": "t1_z"}
    assert raw.reddit_flat(flat)[0][4:7] == (["z"], "Reddit", ["board=b"])
    with pytest.raises(ValueError):
        raw.reddit_flat(flat | {"type": "odd"})
    assert raw.reddit_ad_hominem({"id": "x", "violated_rule": 2})[0][6] == ["AH=1"]
    assert list(raw.loads_all('{"a":1}{"a":2} {"a":3}')) == [{"a": 1}, {"a": 2}, {"a": 3}]


def test_universal_round_trip(spark, make, tmp_path):
    posts = make(post(0, text="a\"b", author="x", at=(1, 2, 3), tags=["t"], lang="en"), post(1, [0, 9], "c", convo="c"), post(5, text="other", convo="d"))
    readers.write_universal(posts, str(tmp_path / "out"), shards=2)
    for i, f in enumerate((tmp_path / "out").glob("part-*.txt")):
        f.rename(tmp_path / f"u{i}.json")
    back = {r["uid"]: r for r in readers.read_universal(spark, str(tmp_path / "u")).collect()}
    want = {r["uid"]: r for r in posts.collect()}
    for uid, r in want.items():
        for c in ("text", "author", "created_at", "reply_to", "platform", "tags", "lang"):
            assert back[uid][c] == r[c]
    assert back["1"]["convo_id"] == "CONV_0" and back["5"]["convo_id"] == "CONV_5"


def test_unknown_platform_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"uid": 1, "text": "t", "created_at": 0, "platform": "odd"}]))
    with pytest.raises(Exception, match="no platform"):
        readers.read_universal(spark, str(tmp_path / "x")).collect()


def test_chan(spark, tmp_path):
    data = {"1": {"no": 12360, "resto": 12345, "time": 9999999999, "name": "Anonymous", "com": "&gt;&gt;12360<br>&gt;&gt;00012361 hi", "x": 1}, "2": {"no": 12361, "resto": 0, "time": 1}, "3": {"no": 12345, "resto": 0, "time": 5, "com": "op"}}
    (tmp_path / "b_00.json").write_text(json.dumps(data))
    got = {r["uid"]: r for r in readers.read_chan(spark, str(tmp_path / "b_")).collect()}
    assert set(got) == {"12360", "12345"} and set(got["12360"]["reply_to"]) == {"12345", "12361"}
    assert got["12360"]["convo_id"] == got["12345"]["convo_id"] == "CONV_12345"
    assert got["12360"]["chunk"] == "00"
    assert got["12360"]["created_at"].year == 2286 and got["12360"]["text"].startswith(">>12360\n")


def test_tweet_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(TWEET) + "\n" + json.dumps({"id": 50, "text": "alone"}) + "\n")
    got = {r["uid"]: r["convo_id"] for r in readers.read_tweets(spark, str(tmp_path / "q")).collect()}
    assert got["7"] == got["123456789101112131415"] != got["50"]
    (tmp_path / "set_topic-tweets.json").write_text(json.dumps({"1": {"id": 1, "text": "x"}}))
    assert readers.read_tweet_threads(spark, str(tmp_path / "set_")).first()["source"] == "topic"


def test_reddit_files(spark, tmp_path):
    line = lambda i, p: json.dumps({"id": i, "author": "a", "created_utc": 1, "subreddit": "b", "type": "comment", "body": "t", "parent_id": p})
    (tmp_path / "2020-01.json").write_text(line("a", "t3_x") + line("b", "t1_a") + line("c", "t1_b"))
    (tmp_path / "2020-02.json").write_text(line("d", "t1_a") + "\n")
    got = {r["uid"]: r["convo_id"] for r in readers.read_reddit(spark, str(tmp_path) + "/", flat=True).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]
    (tmp_path / "ah.jsonl").write_text(json.dumps({"id": "r", "body": "x", "violated_rule": 0}) + "\n")
    assert readers.read_ad_hominem(spark, str(tmp_path / "ah.jsonl")).first()["tags"] == ["AH=0"]


def test_facebook_files(spark, tmp_path):
    for page, folder, name, data in (
        ("pg", "1", "post1.json", json.dumps({"id": "1", "message": "hello"})), ("pg", "1", "comments.json", json.dumps([{"id": "c", "message": "m", "userID": "u"}])),
        ("pg", "2", "post.json", "not json"), ("pg", "2", "replies.json", json.dumps({"data": [{"id": "r", "message": "m"}]})), ("pg", "2", "react.json", "{}"),
    ):
        (tmp_path / page / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / page / folder / name).write_text(data)
    got = {r["uid"]: r for r in readers.read_facebook(spark, str(tmp_path) + "/").collect()}
    assert set(got) == {"1", "c", "2", "r"} and got["2"]["text"] == "[deleted]" and got["2"]["author"] == "pg"
    assert got["c"]["page"] == "pg" and got["c"]["tags"] == []
    readers.convert(spark, "Facebook", str(tmp_path) + "/", str(tmp_path / "out"), by="page")
    assert (tmp_path / "out" / "page=pg").is_dir()
    assert got["c"]["convo_id"] == got["1"]["convo_id"] == "CONV_1" and got["r"]["reply_to"] == ["2"]


def test_facebook_files_are_read_once(spark, tmp_path):
    """Also a folder of files without messages has a post, what lies deeper or higher is no file of a folder, and the result doesn't read the files again."""
    for name, data in (("pg/1/post.json", "{}"), ("pg/1/comments.json", "[]"), ("pg/2/scrape.json", "x"), ("pg/3/post.json", json.dumps({"id": "3_3", "message": "m"})), ("pg/3/replies.json", json.dumps([{"id": "r", "message": "a", "replies": [{"id": "rr", "message": "b"}]}])), ("pg/odd.json", "{}"), ("pg/3/deep/odd.json", "{}")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    posts = readers.read_facebook(spark, str(tmp_path) + "/")
    got = {r["uid"]: (r["text"], r["reply_to"], r["convo_id"]) for r in posts.collect()}
    assert got == {"1": ("[deleted]", [], "CONV_1"), "2": ("[deleted]", [], "CONV_2"), "3_3": ("m", [], "CONV_3_3"), "r": ("a", ["3_3"], "CONV_3_3"), "rr": ("b", ["r"], "CONV_3_3")}
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "MapInPandas" not in plan


def test_thread_files_are_followed_in_pieces(spark, tmp_path):
    """Values come as they get whole, however the text is cut, and no more than one is held; what isn't whole raises."""
    data = {"1": {"id": 1, "text": "a, {b} \"}"}, "2": {"id": 2, "text": "é" * 50}, "3": {"id": 12, "text": "x"}}
    text = json.dumps(data, indent=1) + " {} \n" + json.dumps({"4": 5, "k": [1, 2]}) + "\n"
    want = [*data.values(), 5, [1, 2]]
    for n in (1, 2, 7, 1000):
        members, got, most = raw.Members(), [], 0
        for i in range(0, len(text), n):
            got += members.feed(text[i : i + n])
            most = max(most, len(members.text) - members.at)
        assert got + list(members.feed("", True)) == want
        assert n > 7 or most < 345
    for bad in ('{"1": {"id": 1}', '{"1": ', "[1]", '{"1" 2}', '{"1": 2 3}', '{"1": 2,', '{"1": 2} x'):
        with pytest.raises(ValueError):
            members = raw.Members()
            list(members.feed(bad)) + list(members.feed("", True))
    for k in range(3):
        tweets = {str(i): {"id": i, "text": f"t{i}, {{", "user": {"screen_name": "u"}, "in_reply_to_status_id": k if i > k else None} for i in range(k, 40)}
        (tmp_path / f"s_k{k}-tweets.json").write_text(json.dumps(tweets, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        posts = readers.read_tweet_threads(spark, f"{tmp_path}/s_")
        rows = posts.where("source = 'k1'").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in rows] == [f"t{i}, {{" for i in range(1, 40)] and {r["convo_id"] for r in rows} == {"CONV_1"}
    assert posts.count() == 40 + 39 + 38


def test_sample_files(spark, tmp_path):
    from threadweave.sources import samples

    rows = [(f"a/{i % 3}.json", f"v{i}") for i in range(20)] + [("b.json", "é")]
    samples.write_files(spark.createDataFrame(rows, "name string, value string").repartition(5), str(tmp_path / "out"))
    assert {str(f.relative_to(tmp_path / "out")): sorted(f.read_text().split()) for f in (tmp_path / "out").rglob("*") if f.is_file()} == {
        **{f"a/{k}.json": sorted(f"v{i}" for i in range(20) if i % 3 == k) for k in range(3)}, "b.json": ["é"],
    }


def test_file_order_is_kept(spark, tmp_path):
    tweets = [{"id": 100 - i, "text": f"t{i}", "user": {"screen_name": f"u{i}"}, "in_reply_to_status_id": 100 if i else None} for i in range(8)]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, tweets)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        for reader, name in ((readers.read_tweets, "t"),):
            rows = reader(spark, str(tmp_path / name)).collect()
            assert [r["text"] for r in sorted(rows, key=lambda r: r["seq"])] == [f"t{i}" for i in range(8)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_first_line_of_an_id_names_the_author(spark, tmp_path):
    lines = [{"id": 1, "text": "same", "user": {"screen_name": name}} for name in ("zoe", "amy", "bob")]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    (row,) = readers.read_tweets(spark, str(tmp_path / "t")).collect()
    assert row["author"] == "zoe"


def test_equal_lines_are_two_conversations(spark, tmp_path):
    line = json.dumps([{"uid": 1, "text": "t", "created_at": 0, "platform": "Reddit"}])
    (tmp_path / "x.json").write_text(line + "\n" + line + "\n")
    assert readers.read_universal(spark, str(tmp_path / "x")).count() == 2


def test_no_window_over_a_pool(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"id": 1, "text": "t"}))
    plan = readers.read_tweets(spark, str(tmp_path / "t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "windowspecdefinition(convo_id" in plan


def test_writing_over_something_must_be_asked_for(spark, make, tmp_path):
    posts = make(post(0, text="a"))
    readers.write_universal(posts, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        readers.write_universal(posts, str(tmp_path / "out"))
    readers.write_universal(posts, str(tmp_path / "out"), mode="overwrite")
