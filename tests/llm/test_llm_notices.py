"""Every notice of a merged region is reported, whatever the edits of those after it."""

import random
import time

import pytest

from kinmatch.llm import license_scan


def spans(text):
    return [(f["label"], f["start"], f["end"], f["edits"]) for f in license_scan.scan_text(text, {}, license_scan.NOTICES)[-1]]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("the apache licence apache license x", [("apache", 1, 3, 1), ("apache", 3, 5, 0)]),
        ("mit licence and mit license then mit licence", [("mit", 0, 2, 1), ("mit", 3, 5, 0), ("mit", 6, 8, 1)]),
        (
            "gnu general public licence gnu general public license gnu genral public license",
            [("gpl", 0, 4, 1), ("gpl", 4, 8, 0), ("gpl", 8, 12, 1)],
        ),
    ],
)
def test_notices_side_by_side(text, wanted):
    assert [s for s in spans(text) if s[0] == wanted[0][0]] == wanted


def test_all_planted_places():
    rng = random.Random(8)
    for n in [*range(1, 12), 3000]:
        words, wanted = [], []
        for _ in range(n):
            words += ["zzzz"] * rng.randint(1, 3)
            edits = rng.randint(0, 1)
            wanted.append(("apache", len(words), len(words) + 2, edits))
            words += ["apache", "licence" if edits else "license"]
        assert [s for s in spans(" ".join(words)) if s[0] == "apache"] == wanted


def test_long_texts_take_time_in_proportion():
    for part in ("cc by ", "mit license ", "gnu general public licence "):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            got = license_scan.scan_text(part * n, license_scan.PHRASES, license_scan.NOTICES)
            took.append(time.process_time() - began)
            assert got[0] == n * len(part.split()) and len(got[5]) in (0, n)
        assert took[1] < 9 * took[0] + 1
