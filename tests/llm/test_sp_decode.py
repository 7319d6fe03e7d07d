from srcgraph.llm import queries as Q
from srcgraph.llm import sp_codec as S


def test_decode_is_the_librarys_and_marks_are_replaced_once():
    with open(Q.TOKENIZER, "rb") as f:
        c = S.Codec(f.read())
    texts = ["", " ", "  a", "a b", " lead", "▁x ▁▁", "tab\tand\nline", "é漢字 😀", "a" * 300, "x  y   z ", "▂ ▁"]
    ids = list(c.encode(texts)) + [[], [c.mark_byte, c.mark_byte], list(range(len(c.model.pieces)))]
    byte = {p: i for i, (p, _, t) in enumerate(c.model.pieces) if t == S.BYTE}
    ids += [[byte[f"<0x{b:02X}>"] for b in "▁".encode()] + ids[3], [byte["<0x81>"], byte["<0x96>"]], [byte["<0x20>"], byte["<0x20>"]]]
    assert c.decode(ids) == c.first.decode_batch(ids, skip_special_tokens=False)
    assert c.decode([ids[3]]) == ["a b"]
    assert "Replace" not in repr(c.later.decoder)  # no decoder that works on every piece's text
