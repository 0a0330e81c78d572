import re

from threadweave.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.QUERIES["filter_all"](spark, sf))
    assert re.search(r"PushedFilters: \[[^\]]*In\(lang", text)
    assert "n_chars" not in text.split("ReadSchema")[1]
    own = plan(catalog.QUERIES["user_posts"](spark, sf))
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", own)[1]


def test_one_shuffle_where_one_will_do(spark, sf):
    for name, most in (("depth_distribution", 2), ("messages_per_user", 1), ("type_freq_convo", 1), ("duration", 1), ("entropy_pairs", 1), ("relative_age", 1), ("flags", 1), ("tree_metrics", 2), ("int_sums", 4)):
        assert plan(catalog.QUERIES[name](spark, sf)).count("Exchange hashpartitioning") <= most, name


def test_no_python_in_relational_queries(spark, sf):
    for name in ("before", "novelty", "rank_frequency", "text_histograms", "describe", "response_time", "merge_union"):
        assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, sf))), name


def test_features_are_made_once(spark, sf):
    from threadweave.operators import vectorize
    from threadweave.sources.adapters import conversation_posts

    text = plan(vectorize.PostVectorizer("standard").fit_transform(conversation_posts(spark, sf)))
    assert "MapInArrow" not in text and "Scan parquet" not in text
    assert plan(catalog.QUERIES["normalize_standard"](spark, sf)).count("regexp_extract_all") == 0
