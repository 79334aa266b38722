import re

from keelson.llm import licences

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
software."""
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'


def scan(docs, texts):
    out = licences.scan(docs(texts))
    assert out.columns == ["doc_id", "sentences", "n_sentences", "licences"]
    return {r.doc_id: r for r in out.collect()}


def test_rules(spark, docs):
    got = scan(
        docs,
        [
            (1, MIT), (2, APACHE), (3, "Some text.\nReleased under the MIT License."), (4, "RELEASED under\tthe MIT  license! Licensed under CC BY-NC 4.0."),
            (5, None), (6, ""), (7, "I licensed the mit idea. Copyright law is long."), (8, ("word " * 60_000) + ". Licensed under CC BY 4.0."),
            (9, "Released under the MIT License.\nReleased under the MIT License."),
            (10, "This work is licensed under the GNU General Public License, version 3. All rights reserved."),
        ],
    )
    assert got[1].licences == "MIT" and got[1].sentences == "<mit-grant><mit-notice>"
    assert got[2].licences == "Apache-2.0" and got[2].n_sentences == 2
    assert got[3].licences == "MIT" and got[4].licences == "MIT,CC-BY-NC-4.0"
    assert {got[i].licences for i in (5, 6, 7)} == {""} and got[7].n_sentences == 0
    assert got[8].licences == "CC-BY-4.0"
    assert got[9].n_sentences == 2 and got[9].licences == "MIT"
    assert got[10].licences == "GPL-3.0-only,all-rights-reserved"


def test_order_matters_and_matches_are_used_up(spark, docs):
    apache = APACHE.split("\n")
    got = scan(docs, [(1, "\n".join(apache[::-1])), (2, APACHE)])
    assert got[1].sentences == "<apache-2-use><apache-2-by>" and got[1].licences == "Apache-2.0"
    grant, notice = MIT.split("\n\n")[1:]
    got = scan(docs, [(1, notice + "\n\n" + grant)])
    assert got[1].sentences == "<mit-notice><mit-grant>" and got[1].licences == ""


def test_every_sentence_holds_a_trigger():
    for s in licences.SENTENCES:
        assert re.search(licences.TRIGGER, s) and re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s)
    known = set(licences.SENTENCES.values())
    assert all(x in known for rule, _ in licences.RULES for x in rule)
    seen = [r for r, _ in licences.RULES]
    for i, r in enumerate(seen):
        for longer in seen[i + 1 :]:
            assert not "".join(f"<{x}>" for x in r) in "".join(f"<{x}>" for x in longer), "a longer rule comes too late"


def test_empty(spark, docs):
    assert licences.scan(docs([])).collect() == []


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAME = """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def test_notices_as_they_are_printed(spark, docs):
    texts = [GPL2, GPL3, LGPL, BSD, BSD + NAME, ISC, MPL, "This is free and unencumbered software released into the public domain."]
    got = scan(docs, list(enumerate(texts)))
    want = ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense"]
    assert [got[i].licences for i in range(len(texts))] == want
    assert got[0].sentences == "<gpl-terms><later-2><gpl-warranty><gpl-see><gpl-copy>"
