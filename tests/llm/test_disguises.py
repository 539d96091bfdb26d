import itertools
import re

import pytest

from lodeweave.llm import toxicity
from lodeweave.llm.common import table
from tests.llm.test_models import SF


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.language_model(table(spark, SF, "documents")))


@pytest.mark.parametrize(
    ("word", "disguise"),
    [("idiot", d) for d in ("!diot", "*diot", "|diot", "(!diot)", "idiiot", "iddiot", "i d i o t", "i  d  i o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i d ! o t", "1 d 1 0 t", "! d ! o t", "i d i o t.", '"i d i o t"', "i . d . i . o . t")]
    + [("clown", "(lown"), ("clown", "<lown"), ("loser", "|oser"), ("stupid", "stuupid"), ("stupid", "s t u p ! d")],
)
def test_disguises_reach_the_lattice(restorer, word, disguise):
    assert word in restorer.words(f"The {disguise} of it."), disguise


def test_plain_words_stay(restorer):
    assert {"letter", "all", "see", "see", "good"} <= restorer.words("All (see letter)! Good.")


def test_dollar_signs_are_letters_or_nothing(restorer):
    assert "stupid" in restorer.words("The $$$tupid of it.")
    assert "scum" in restorer.words("The $$$cum of it.")
    assert restorer.words("junk $$$ here $$$$") == {"junk", "here"}


def every_path(restorer, token):
    """The best of all ways through the lattice, each scored sign by sign."""
    best = None
    for path in itertools.product(*restorer.lattice(token)):
        score, context = 0.0, (0, 0, 0)
        for _, symbol, cost in path:
            score += cost
            if symbol is not None:
                score += restorer.model[((context[0] * 28 + context[1]) * 28 + context[2]) * 28 + symbol]
                context = (*context[1:], symbol)
        score += restorer.model[((context[0] * 28 + context[1]) * 28 + context[2]) * 28]
        way = (round(score, 6), "".join(shown for shown, _, _ in path))
        best = max(best, way) if best else way
    return best


@pytest.mark.parametrize("token", ["1d1ot", "f*ck", "*d**t", "that***", "$$$tupid", "stuupid", "letter", "ii", "aab", "süüß", "(!diot)", "|0s3r", "i d ! o t", "s-t-u-p", "l00k", "*", "a*"])
def test_search_finds_the_best_of_all_paths(restorer, token):
    score, text = restorer._best(token)
    want = every_path(restorer, token)
    assert text == want[1] and score == pytest.approx(want[0], abs=1e-5)


def test_words_are_those_of_the_restored_text(restorer):
    text = "The 1d1ot said: h3llo, w0rld! (it was f*ck1ng b4d) and *stup1d*, s c u m"
    assert restorer.words(text) >= set(re.findall(r"[^\W\d_]+", restorer.restore(text)))
