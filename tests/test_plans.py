"""Plan shape guards: no cartesian products, no single-partition windows, and the
wide html column is never shuffled once pages are parsed."""
import contextlib
import io
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["catalog_by_department", "resolve_category", "build_skus", "image_plan",
                                  "attempt_cutoff", "retry_schedule", "listing_harvest", "even_sample",
                                  "batches", "extract_products", "run_workflow", "crawl_reach_capped",
                                  "expand_sitemaps", "with_url_reviewer"])
def test_no_cartesian_or_global_window(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    # every Window node has partition columns ("Arguments: [exprs], [partition], [order]")
    for args in re.findall(r"\) Window\n(?:.*\n)*?Arguments: (.*)\n", text):
        parts = args.split("], [")
        assert len(parts) >= 3 and parts[1].strip() != "", args


def test_html_not_shuffled_after_parse(spark):
    text = plan_text(E.queries()["extract_products"](spark, SF))
    for line in text.splitlines():
        if line.strip().startswith("Arguments") and "hashpartitioning" in line:
            assert "html" not in line
