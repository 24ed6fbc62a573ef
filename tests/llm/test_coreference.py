"""Names that a title introduced, met again without it."""

from frostline.llm import surrogates


def test_names_met_again():
    t = "Mrs Anna Schmidt came. Anna Schmidt sat; Anna's hat, annals, Annabel and Anna-Lena stayed. Dr. Anna Schmidt left."
    new, found = surrogates._replaced(t, b"k", {})
    assert [f["type"] for f in found] == ["given:f:Latn", "family:Latn"] * 2 + ["given:f:Latn"] + ["given:f:Latn", "family:Latn"]
    given, family = found[0]["surrogate"], found[1]["surrogate"]
    assert all(f["surrogate"] == (given if f["type"].startswith("given") else family) for f in found)
    assert new == f"Mrs {given} {family} came. {given} {family} sat; {given}'s hat, annals, Annabel and Anna-Lena stayed. Dr. {given} {family} left."


def test_second_titles_stay():
    new, _ = surrogates._replaced("Frau Dr Weber spoke. The Dr was late.", b"k", {})
    assert new.endswith("spoke. The Dr was late.")


def test_other_scripts():
    new, found = surrogates._replaced("Госпожа Ирина Петрова. Потом Ирина ушла.", b"k", {})
    assert len(found) == 3 and found[0]["surrogate"] == found[2]["surrogate"]
