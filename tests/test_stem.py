from litsift.functions.stem import stem

# Pairs from the published description of the English (Porter2) stemmer.
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign",
    "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consisting": "consist", "consists": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "console": "consol",
    "consoled": "consol", "consoles": "consol", "consolidate": "consolid",
    "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol",
    "knack": "knack", "knackered": "knacker", "knave": "knave", "knavish": "knavish",
    "kneaded": "knead", "knee": "knee", "kneel": "kneel", "kneeling": "kneel",
    "knelt": "knelt", "knew": "knew", "knife": "knife", "knights": "knight",
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "running": "run",
    "hopping": "hop", "hoping": "hope", "generously": "generous", "skies": "sky",
    "dying": "die", "news": "news", "proceed": "proceed", "cells": "cell",
    "studies": "studi", "allergy": "allergi", "allergic": "allerg",
}


def test_known_pairs():
    bad = {w: (stem(w), s) for w, s in PAIRS.items() if stem(w) != s}
    assert not bad


def test_short_words_unchanged():
    assert stem("a") == "a" and stem("is") == "is"
