import re

from augury.llm import private

FOUND = [("PASSWORD=hunter2abc", "hunter2abc"), ("API_KEY=Zk39fkQ02mmA", "Zk39fkQ02mmA"), ("Password: correcthorse1", "correcthorse1"),
         ("client_secret=abcd1234efgh", "abcd1234efgh"), ("access_token: q9w8e7r6t5", "q9w8e7r6t5"), ('{"password": "p@ss;word!9"}', "p@ss;word!9"),
         ("secretAccessKey='wJalrXUtnFEMI'", "wJalrXUtnFEMI"), ("call 555 123 4567 now", "555 123 4567"), ("pay 2221 0000 0000 0009", "2221 0000 0000 0009"),
         ("pay 3782 822463 10005", "3782 822463 10005"), ("from 2001:db8:85a3::8a2e:370:7334 on", "2001:db8:85a3::8a2e:370:7334"),
         ("at fe80::1.", "fe80::1"), ("at 2001:0DB8:0:0:1:2:3:4", "2001:0DB8:0:0:1:2:3:4"), ("mail jürgen.größe@example.org", "jürgen.größe")]
LEFT = ["Secretary: Elizabeth went", "SECRETARY: ELIZABETH", "std::string face::bad", "at 12:30:45", "2221 0000 0000 0008", "tokenization: understanding"]


def test_common_forms_are_replaced_and_others_left(make):
    rows = [(i, t) for i, (t, _) in enumerate(FOUND)] + [(100 + i, t) for i, t in enumerate(LEFT)]
    got = {r["doc_id"]: r for r in private.replace_private(make(rows), "k").collect()}
    for i, (text, value) in enumerate(FOUND):
        new = got[i]["text"]
        assert got[i]["n_replaced"] == 1 and value not in new, (text, new)
        assert len(new) == len(text) and new.startswith(text[:text.index(value)]), (text, new)
        assert re.sub(r"\w", "x", new) == re.sub(r"\w", "x", text), (text, new)
    assert [got[100 + i]["text"] for i in range(len(LEFT))] == LEFT
