import re

from lakeloom.llm.url_filter import HOST_RULES, RULES, WORD_RULES, Rule, filter_urls


def test_rules_as_a_table(spark):
    """The same verdicts from a table of rules as from a list, and many rules under one token."""
    urls = [(i, f"http://h{i % 40}.example{i % 3}.com/p{i % 7}/x{i}") for i in range(300)] + [(1000, None), (1001, "casino.net"), (1002, "http://casino.net/"), (1003, "http://a/" + "b/" * 50_000 + "end")]
    rules = [Rule(f"r{i}", "block", rf"^h{i}\.example{i % 3}\.com/p{i % 7}/", ("h:com", f"h:h{i}"), 0, i) for i in range(60)] + [Rule("end", "block", r"/end$", ("p:end",), 1)]
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    table = spark.createDataFrame([(r.name, r.action, r.pattern, list(r.literals), r.tier, r.weight) for r in rules + rules[:5]], RULES)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    got = key(filter_urls(df, table))
    assert got == key(filter_urls(df, rules)) and len(got) == len(urls)
    for page, host, path, rule, verdict, _ in got:
        fit = [r for r in rules if re.search(r.pattern, host + path)]
        assert (rule, verdict) == ((min(fit, key=lambda r: (r.tier, -r.weight, r.name)).name, "block") if fit else (None, "allow")), page
    assert sum(v == "block" for *_, v, _ in got) > 5 and got[-1] is not None


def test_no_python_and_one_shuffle_of_urls(spark):
    df = spark.createDataFrame([(1, "http://a.net/en/x")], "page_id long, url string")
    plan = filter_urls(df, [*HOST_RULES, *WORD_RULES])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
