"""Hard-wrapped prose is read like the same prose on one line; a fence that isn't closed fences nothing."""

import textwrap

import pytest

from lodestream.llm import packing, reading_level

SENTENCES = (
    "The committee shall, upon receipt of the petition and after due consideration of the evidence, determine whether the claim is admissible. "
    "Where the tribunal finds that the obligation was discharged before the period of limitation began, it must dismiss the application without further inquiry. "
    "Nothing in this provision restricts the authority of the court to award such costs as it deems proportionate to the conduct of the parties. "
    "The respondent may nevertheless appeal against the decision within thirty days of its notification by the registrar."
)


@pytest.mark.parametrize("width", [50, 72, 100, 120])
def test_wrapping_changes_nothing(width):
    flat, wrapped = (reading_level.read_document(t) for t in (SENTENCES, textwrap.fill(SENTENCES, width, break_on_hyphens=False)))
    assert flat == wrapped and flat[1] and sum(flat[3]) > 60


def test_lists_names_and_footers_stay_out():
    around = ["Quarterly report of the harbour office", "- the first of many items that we keep in the list.", "Subscribe to the letter", "© 2024 The harbour office and its partners, all rights reserved"]
    text = "\n".join([around[0], "", SENTENCES, around[1], around[2], around[3]])
    assert reading_level.prose_lines(text) == [SENTENCES]


def test_unclosed_fence():
    assert reading_level.prose_words(f"```\n{SENTENCES}") == reading_level.prose_words(SENTENCES)
    assert reading_level.prose_words(f"```\n{SENTENCES}\n```") == []
    assert reading_level.prose_words(f"```\nx = 1\n```\n{SENTENCES}\n```") == reading_level.prose_words(SENTENCES)


@pytest.mark.parametrize("capacity", [0, -1, 1 << 19])
def test_capacity_that_cannot_be_ranked_is_an_error(spark, capacity):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2)], "doc_id long, n long"), "doc_id", "n", capacity)
