from rows import post

from threadweave.plans import catalog, metrics


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["n"] for r in df.collect()}


def test_token_frequencies_per_group(make):
    posts = make(post(1, text="to be To", lang="en"), post(2, text="be", lang="fr"), post(3, text="\n\t\u00a0", lang="fr"))
    got = counts(metrics.token_frequencies(posts), "grp", "token")
    english = {("to", 1), ("be", 1), ("To", 1), (" ", 2)}
    want = {(g, t): n for g in ("en", "en_und") for t, n in english} | {("fr", "be"): 1, ("all", "to"): 1, ("all", "be"): 2, ("all", "To"): 1, ("all", " "): 2}
    assert got == want


def test_pairs_of_tokens_and_types_per_conversation(make):
    posts = make(
        post(1, text="a b", lang="en", convo="c"), post(2, [1], text="a", lang="fr", convo="c"), post(3, text="", lang="fr", convo="d"), post(4, [3], text="", lang="fr", convo="d"), post(5, text="alone", lang="en", convo="e")
    )
    got = counts(metrics.convo_novelty_histograms(posts), "grp", "measure", "value")
    want = {("en", "4-3"): 1, ("en_und", "4-3"): 1, ("fr", "4-3"): 1, ("fr", "0-0"): 1, ("all", "4-3"): 1, ("all", "0-0"): 1}
    assert got == {(g, "tokens-types", v): n for (g, v), n in want.items()}


def test_all_graph_histograms_are_registered(spark, sf):
    assert {r["measure"] for r in catalog.QUERIES["convo_graph_histograms"](spark, sf).select("measure").distinct().collect()} == {"tree_depth", "tree_width", "degrees"}
    assert {"token_frequencies", "convo_novelty_histograms", "convo_graph_histograms"} <= set(catalog.ORACLES)
