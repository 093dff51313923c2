import random
import re

import numpy as np

from cellweave.llm import licenses, queries
from cellweave.llm.license_texts import OTHERS, TEXTS

FOLDER = "/root/testdata/sf0.01"
LINES = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}


def plain(text, model):
    """The scan in plain Python: (families, number of paragraphs with a trigger word and nothing confirmed)."""
    held_by, sure, spoken = licenses.all_texts(), [], set()
    reach = max(len(licenses._words(t)) for ts in held_by.values() for t in ts)
    years = {f"{w} {y}" for w in ("copyright", "c") for y in range(1970, 2100)} | {"copyright c"}
    for k, paragraph in enumerate(re.split("\n(?:[^a-z0-9\n]*\n)+", (text or "").lower())):
        lines, named = paragraph.split("\n"), []
        for line in lines:
            hit = re.search(licenses.BEFORE_NAMES, line)
            parts = re.split(licenses.BETWEEN_NAMES, hit[2]) if hit else [""]
            named += [(licenses._words(hit[1]) + licenses._words(x), True) for x in parts] if len(parts) > 1 else []
        words = licenses._words(paragraph)
        windows = lambda n: [(words[a : a + n], False) for a in (range(0, len(words), n // 2) if len(words) > n else [0])]  # noqa: B023, E731
        units = [(licenses._words(x), True) for x in lines] + named + (windows(2 * reach) if len(lines) > 1 else []) + (windows(licenses.WINDOW) if len(words) > licenses.WINDOW else [])
        units = [x for x in units if set(x[0]) & set(licenses.TRIGGERS)]
        spoken |= {k} if units else set()
        signed = any(years & set(licenses._pairs_of(x)) for x, _ in units)
        here = []
        for (unit, alone), chances in zip(units, model.chances([x for x, _ in units]) if units else []):
            pairs = set(licenses._pairs_of(unit))
            for family, chance in zip(model.classes[:-1], chances):
                held = [(len(pairs & set(own)) / len(own), pairs & set(own), n, short) for n, (own, short) in enumerate((licenses._pairs_of(licenses._words(t)), len(licenses._words(t)) < licenses.SHORT) for t in held_by[family])]
                texts = {n for s, _, n, short in held if s >= (1 if short and not alone else licenses.CONFIRM) and not (short and pairs & set(licenses.DENIALS))}
                if chance >= model.least and texts:
                    here.append((k, family, *max(held, key=lambda h: h[0])[:2], texts, signed))
        sure += [f for f in here if not any(g[2] > f[2] and 2 * len(f[3] & g[3]) > len(f[3]) for g in here)]
    found = set()
    for k, family, _, _, texts, signed in sure:
        near = [(p, f, ts) for p, f, _, _, ts, _ in sure if abs(p - k) <= licenses.NEAR]
        name = family
        for own, shared, other, needs, bars in licenses.SHARED:
            holds = lambda start: any(f == own and ts & set(licenses._starting(own, start)) for _, f, ts in near)  # noqa: B023, E731
            if family == own and texts <= set(licenses._starting(own, shared)) and all(holds([n]) for n in needs) and not holds(bars):
                name = other
        reserved = family == "Proprietary" and signed and texts <= set(licenses._starting(family, ["All rights reserved."]))
        if not (reserved and any(f != "Proprietary" and p >= k for p, f, _ in near)):
            found.add((k, name))
    return sorted({f for _, f in found}), len(spoken - {k for k, _ in found})


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(df, licenses.train()).collect()}
    return [rows[k] for k in range(len(texts))]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.QUERIES["op10_license_scan"](spark, FOLDER).collect()}
    want = {i: ",".join(sorted({LINES[x] for x in t.split("\n") if x in LINES})) for i, t in texts.items()}
    assert {i: r.licenses for i, r in found.items()} == want
    assert sum(map(bool, want.values())) > 10
    some = [i for i, t in texts.items() if any(w in t.lower() for w in licenses.TRIGGERS)][:60]
    assert [(found[i].licenses, found[i].n_unknown) for i in some] == [(",".join(f), u) for f, u in (plain(texts[i], licenses.train()) for i in some)]


def test_plan_is_native(spark):
    plan = queries.QUERIES["op10_license_scan"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)


def test_recall_and_false_alarms():
    """Of held-out variants; and the model is the same on every run."""
    model = licenses.train()
    assert model.recall > 0.97 and model.false_alarms < 0.02
    again = licenses.train.__wrapped__()
    assert np.allclose(model.weights, again.weights, atol=1e-3) and model.least == again.least


def test_edges(spark):
    rows = [
        (1, "MIT stands here.\nReleased under the MIT Licence, see below."),
        (2, None),
        (3, ""),
        (4, "A driving license is required.\n\nSee the LICENSE file for details."),
        (5, "x " * 20000 + "Licensed under the Apache License, Version 2.0."),
        (5, "x " * 20000 + "Licensed under the Apache License, Version 2.0."),
        (None, "This work is licensed under the GNU General Public License, version 2.\n\nThis work is licensed under the GNU General Public License, version 3."),
        (7, "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0."),
    ]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, unknown int, _other string")
    found = licenses.scan(df, licenses.train()).collect()
    assert [r.licenses for r in found] == [["MIT"], [], [], [], ["Apache-2.0"], ["Apache-2.0"], ["GPL-2.0", "GPL-3.0"], ["CC-BY-4.0", "CC-BY-SA-4.0"]]
    assert found[3].unknown == 2 and found[1].unknown == 0 and (found[0].paragraphs[0].paragraph, found[0].paragraphs[0].line) == (0, 1)
    assert licenses.scan(df.limit(0), licenses.train()).count() == 0


def test_each_text_is_its_own_family(spark):
    wrap = lambda t: "\n".join(" ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    texts = [(family, x) for family, ts in licenses.all_texts().items() for t in ts for x in (t, wrap(t), "# " + wrap(t).replace("\n", "\n# "))]
    found = scanned(spark, [t for _, t in texts])
    assert [(f, t[:60], r.licenses) for (f, t), r in zip(texts, found) if r.licenses != [f]] == []


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def test_wrapped_notices(spark):
    star = lambda text: "\n".join(" * " + x for x in text.split("\n"))
    narrow = lambda text: "\n".join(text.split())
    rows = [
        ("MIT License\n\nCopyright (c) 2011 Some One\n\n" + MIT, ["MIT"]),
        (BSD, ["BSD-3-Clause"]),
        (GPL, ["GPL-3.0"]),
        (star(GPL) + "\n *\n" + star(MIT), ["GPL-3.0", "MIT"]),
        (MIT + "\n" + BSD, ["BSD-3-Clause", "MIT"]),
        ("Plain words of ther.\n" + narrow(BSD), ["BSD-3-Clause"]),
        ("x " * 5000 + BSD + " y" * 5000, ["BSD-3-Clause"]),
        # The version alone tells these apart.
        ("This work is licensed under the GNU General Public License,\nversion 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License,\nversion 2.", ["GPL-2.0"]),
        ("Licensed under CC BY-NC 4.0.\nSome thre words.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
        # Pieces of two licences make no third one.
        ("Licensed under CC BY-SA 4.0.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "CC-BY-SA-4.0"]),
        # A blank line ends a paragraph.
        ("Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions are met", []),
    ]
    found = scanned(spark, [t for t, _ in rows])
    assert [r.licenses for r in found] == [want for _, want in rows]
    assert [(r.licenses, r.unknown) for r in found] == [plain(t, licenses.train()) for t, _ in rows]


def test_texts_that_are_no_templates(spark):
    """Reworded notices are found; sentences with the same words that name no licence aren't."""
    named = [
        ("This project is released under the terms of the MIT license.", None),
        ("Unless otherwise noted, all code here is licensed under the Apache License, Version 2.0, as found in the top folder.", "Apache-2.0"),
        ("All our figures are licensed under a Creative Commons Attribution 4.0 International License unless the caption says otherwise.", "CC-BY-4.0"),
        ("(c) 2019 The Company. All rights reserved worldwide.", "Proprietary"),
        ("In addition this library is free software; you can redistribute it and modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.", "LGPL-2.1"),
    ]
    found = scanned(spark, [t for t, _ in named])
    assert [r.licenses for r, (_, f) in zip(found, named) if f] == [[f] for _, f in named if f]
    rnd = random.Random(4)
    words = [w for ts in [*TEXTS.values(), OTHERS] for t in ts for w in licenses._words(t)]
    none = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 40))) + " license" for _ in range(200)] + OTHERS
    none = [t for t in none if not re.search("(?i)\\b(mit|isc|zlib) license", t)]  # these are titles
    assert [(t, r.licenses) for t, r in zip(none, scanned(spark, none)) if r.licenses] == []


# Whole licences as they are printed, beyond the excerpts that the scanner's texts are.
HEAD = "Copyright (c) 2011, Some One\nAll rights reserved.\n\n"
GRANT = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
FIRST = "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
SECOND = "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
THIRD = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\nFOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR\nSERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER\nCAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,\nOR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE\nOF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n'
BSD2, BSD3 = HEAD + GRANT + FIRST + SECOND + DISCLAIMER, HEAD + GRANT + FIRST + SECOND + THIRD + DISCLAIMER
ISC = 'Copyright (c) 2004-2010 by Some Consortium. All rights reserved.\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\nINDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM\nLOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR\nOTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR\nPERFORMANCE OF THIS SOFTWARE.\n'
ZLIB = "Copyright (C) 1995 Some One\n\nThis software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.\n"


def test_printed_licences(spark):
    flat = lambda t: " ".join(t.split())
    one = lambda t: "\n".join(x for x in t.split("\n") if x.strip())
    star = lambda t: "\n".join(" * " + x for x in t.split("\n"))
    rows = [(form(t), [family]) for t, family in ((BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (ISC, "ISC"), (ZLIB, "Zlib")) for form in (str, flat, one, star)]
    rows += [
        (BSD2 + "\n\n" + "\n\n".join(["Other words."] * 20) + "\n\n" + BSD3, ["BSD-2-Clause", "BSD-3-Clause"]),
        ("Copyright 2020 Some One. All rights reserved.", ["Proprietary"]),
        ("All rights reserved.", ["Proprietary"]),
    ]
    found = scanned(spark, [t for t, _ in rows])
    assert [(t[:40], r.licenses) for (t, want), r in zip(rows, found) if r.licenses != want] == []
    assert [(r.licenses, r.unknown) for r in found] == [plain(t, licenses.train()) for t, _ in rows]


def test_names_expressions_and_denials(spark):
    rows = [
        ("Licensed under MIT OR Apache-2.0.", ["Apache-2.0", "MIT"]),
        ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", ["BSD-3-Clause", "GPL-2.0"]),
        ("SPDX-License-Identifier: Apache-2.0 AND MIT", ["Apache-2.0", "MIT"]),
        ("Licensed under either of Apache License, Version 2.0 or the MIT license", None),
        ("This tool is licensed under the GPLv3", ["GPL-3.0"]),
        ("licensed under the LGPLv3 or later", None),
        ("The 2-Clause BSD License applies", ["BSD-2-Clause"]),
        ("This file is not licensed under the MIT License.", []),
        ("It isn't released under the MIT License.", []),
        ("The code is no longer licensed under the GPLv3.", []),
        ("This file is not licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ]
    found = scanned(spark, [t for t, _ in rows])
    assert [(t, r.licenses) for (t, want), r in zip(rows, found) if want is not None and r.licenses != want] == []
    assert [r.unknown for r in found[7:10]] == [1, 1, 1]
    assert [(r.licenses, r.unknown) for r in found] == [plain(t, licenses.train()) for t, _ in rows]


def test_many_mentions(spark):
    """Findings are compared within their paragraph only."""
    text = "\n\n".join(f"Part {k}.\nReleased under the MIT License." for k in range(3000))
    found = scanned(spark, [text, "Released under the MIT License.\n" * 300])
    assert [r.licenses for r in found] == [["MIT"], ["MIT"]] and sum(p.confirmed for p in found[0].paragraphs) >= 3000
