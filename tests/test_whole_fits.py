"""The tail fits take every author; only the summary (and the exact exponents) have the cap on works."""

import pytest


@pytest.mark.parametrize("name", ["tail_fit", "tail_fit_best"])
def test_works_of_every_author_are_fitted(spark, sf, name):
    from tiermark.plans import bindings, registry

    people = bindings.h1_by_author(spark, sf)
    assert not people.where("works_count > 15").isEmpty()
    rows = registry.QUERIES[name](spark, sf).where("label = 'authors_size'")
    count = "n_total" if name == "tail_fit_best" else "n_tail"
    assert rows.agg({count: "max"}).first()[0] == people.count()
