"""Each rule on what it says, and official wordings."""

import re
from re import _parser

from inkveil.llm import licenses

OFFICIAL = {
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2.0-or-later",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3.0-or-later",
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-or-later",
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl-3.0-or-later",
    "GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation": "gfdl-1.3-or-later",
    "GNU General Public License version 2 as published by the Free Software Foundation": "gpl-2.0",
    "Creative Commons Attribution 4.0 International": "cc-by-4.0",
    "Creative Commons Attribution-NonCommercial 4.0 International Public License": "cc-by-nc-4.0",
    "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
    "Creative Commons Attribution-NoDerivatives 4.0 International": "cc-by-nd-4.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa-4.0",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International": "cc-by-nc-nd-4.0",
    "Creative Commons Attribution-NoDerivs 3.0 Unported": "cc-by-nd-3.0",
    "Creative Commons Attribution-Noncommercial-No Derivative Works 3.0 Unported": "cc-by-nc-nd-3.0",
    '"THE BEER-WARE LICENSE" (Revision 42)': "beerware", "the Beerware license": "beerware",
    "CreativeML Open RAIL-M License": "openrail", "an Open RAIL license": "openrail",
    "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0": "cddl-1.0", 'the Open Software License ("OSL") v. 3.0': "osl-3.0",
    "Zope Public License (ZPL) Version 2.1": "zpl-2.1", "LaTeX Project Public License, LPPL Version 1.3c": "lppl-1.3c", "CeCILL FREE SOFTWARE LICENSE AGREEMENT Version 2.1": "cecill-2.1",
    "the Apache License, Version 2.0": "apache-2.0", "Mozilla Public License, v. 2.0": "mpl-2.0", "Eclipse Public License - v 2.0": "epl-2.0",
}


def _said(parsed, most):
    """What a pattern says with as much of the optional as possible, or as little."""
    out = ""
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += _said(value[2], most) * (min(value[1], 3) if most else value[0])
        elif name == "SUBPATTERN":
            out += _said(value[3], most)
        elif name == "BRANCH":
            out += _said(value[1][-1 if most else 0], most)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            out += "x" if str(value[0][0]) == "NEGATE" else chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
        else:
            raise ValueError(name)
    return out


def test_each_rule_matches_what_it_says():
    for rule in licenses.RULES:
        for most in (False, True):
            words = _said(_parser.parse(rule.pattern), most).split()
            assert re.fullmatch(rule.regex, f" {'  '.join(words)} "), (rule, words)
            assert rule.keyword in words, (rule, words)


def test_official_wordings(spark):
    texts = list(OFFICIAL)
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        text = texts[r["doc_id"]]
        named = [d["label"] for d in r["detections"] if d["label"].split("-")[0] == OFFICIAL[text].split("-")[0]]
        assert named == [OFFICIAL[text]], (text, named)
