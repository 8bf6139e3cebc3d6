"""Texts of languages that were not learnt are rejected; texts of the learnt ones stay."""

import random

import pytest
from pyspark.sql import functions as F

from contourlake.llm import langid

WORDS = {
    "en": "the house and of street with water because under people morning which would thing after great never through light small world every night between year children school found where right still country father".split(),
    "de": "das haus und der strasse mit wasser weil unter leute morgen welche wurde sache nach gross niemals durch licht klein welt jede nacht zwischen jahr kinder schule gefunden wo rechts noch land vater".split(),
    "fi": "talo ja katu kanssa vesi koska alla ihmiset aamu joka olisi asia jälkeen suuri koskaan läpi valo pieni maailma yö välissä vuosi lapset koulu löytyi missä oikea vielä maa isä kyllä hyvää".split(),
    "ru": "дом и улица с вода потому под люди утро который вещь после большой никогда через свет маленький мир ночь между год дети школа".split(),
}


def texts(lang, n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(20, 60))) for _ in range(n)]


@pytest.mark.parametrize("each", [15, 400])
def test_unlearned_languages_are_rejected(docs, each):
    rows = [(i, t, lang) for lang in ("en", "de") for i, t in enumerate(texts(lang, each, lang), 1000 * (lang == "de"))]
    model = langid.train_language_id(docs(rows), F.lit(True))
    rnd = random.Random(5)
    junk = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(40)) for _ in range(20)]
    strange = [(i, t) for i, t in enumerate(texts("fi", 20, 1) + texts("ru", 20, 2) + junk)]
    assert langid.keep_identified(docs(strange), model).count() == 0
    known = [(i, t) for i, t in enumerate(texts("en", 100, 3) + texts("de", 100, 4))]
    assert langid.keep_identified(docs(known), model).count() >= 190
