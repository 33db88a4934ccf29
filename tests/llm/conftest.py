from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, spans string, bucket long, label string, block int, range int, base string, h long, start long, size long, id string, mark string"


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, personal data, tokens of the vocabularies, odd letters."""
    r = random.Random(3)
    words = ["alpha", "beta,", "gamma.", "Delta", "épée", "straße", "日本", "x1", "y-2", "don't", "idiot", "clown"]
    long = " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(30_000))
    body = [f"w{r.randrange(10_000)}" for _ in range(120)]
    near = body[:60] + ["changed"] + body[61:]
    far = body[:40] + [f"z{i}" for i in range(80)]
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, long, "en", "a"), (5, " ".join(body), "en", "b"), (6, " ".join(body), "en", "b"), (7, " ".join(near).upper(), "en", "b"),
        (8, " ".join(far), "en", None), (9, "one two three", "en", "c"), (10, "One two\nthree", "en", "c"), (11, "mail a.b+c@x-y.example.org, or x@y@z.example.com! ip 1.2.3.256 10.0.0.1 1.2.3.4.5", "en", "c"),
        (12, "card 4111 1111 1111 1111 and 4111111111111112 call +1 (017) 555-7713 or +12", "en", "c"), (13, "see <|endoftext|> and <|startoftext|> here  now '' it's we'LL 12 345", "en", "c"), (14, "same line here\nsame line here\nsame line here\nanother one of ten words is here to be long", "en", "c"),
        (14, "same line here\nsame line here\nsame line here\nanother one of ten words is here to be long", "en", "c"), (None, "no id at all but ten words are here to be kept now", "en", "d"), (15, "x" * 9000, "en", "d"), (16, ("ab" * 700), "en", "d"),
        (17, "This work is free. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. Redistribution is bad", "en", "d"), (18, "y" * 450 + " tail \U0001f600 of it", "en", "d"), (19, "z" * 450 + " tail of it", "en", "d"),
    ]


@pytest.fixture(scope="session")
def odd(spark, texts):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "r", "s", 1, "l", 1, 1, "b", 1, 1, 1, "i", "m") for i, t, lang, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
