from strandflow.llm import stuffed


def test_coverage_is_asked_for_only_where_it_can_count(monkeypatch):
    """Sentences alone, and HTML that only says the plain text again, ask for no second automaton; the result is that of judging all."""
    asked = []
    whole = stuffed.repeated
    monkeypatch.setattr(stuffed, "repeated", lambda symbols: asked.append(len(symbols)) or whole(symbols))
    prose = "We looked at the old bridge near the river today. It was closed for repair since last winter. The engineers hope to open it again in May."
    words = "cheap watches, best watches, cheap watches online, best watches online, cheap watches sale, best watches sale"
    assert stuffed.stuffing(prose) == (0, stuffed.stuffing(prose)[1]) and not asked
    both = f'Content-Type: multipart/alternative; boundary="xyzxyz"\n\n--xyzxyz\nContent-Type: text/plain\n\n{words}\n--xyzxyz\nContent-Type: text/html\n\n<html><p>{words}</p></html>\n--xyzxyz--\n'
    got = stuffed.stuffing(both)
    assert len(asked) == 1
    assert got == stuffed.stuffing(words) and got[0] > 0
