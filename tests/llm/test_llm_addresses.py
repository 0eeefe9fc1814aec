"""Spelled addresses and other formats of personal data."""

import random

import pytest

from lapsegrid.llm import pii

FORMS = [
    "joe.b [at] mail [dot] example [dot] com", "joe.b (at) mail.example.com", "joe @ mail.example.com", "joe( at )mail.com", "JOE.B AT MAIL DOT EXAMPLE DOT COM", "JOE(AT)MAIL.COM", "joe [ at ] mail.com",
    *(f for kind, found in (("email", "joe.b@mail.example.com"), ("card", "4041 8949 7460 8795"), ("phone", "+1 (988) 555-2485")) for f in pii._rewritten(kind, found, random.Random(1))),
]


@pytest.mark.parametrize("form", FORMS)
def test_every_form_is_proposed(form):
    text = f"Please write to us, {form}, before noon"
    begin = text.index(form)
    assert any((a, b) == (begin, begin + len(form)) for _, a, b in pii.candidates(text))


def test_forms_of_addresses_are_found(spark):
    model = pii.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for form in pii._rewritten("email", "joe.b@mail.example.com", random.Random(1)):
        text = f"Please write to us, {form} before noon"
        begin = text.index(form)
        assert ("email", begin, begin + len(form)) in pii.find(text, model)[1], form
