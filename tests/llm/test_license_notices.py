"""Every licence rule against the public notice it is named for, as it stands, wrapped and commented."""

import textwrap

from retail_spark.llm.license_scan import RULES, SENTENCES, SIGNS, VARIANTS, license_scan

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL2 = GPL3.replace("software:", "software;").replace("version 3", "version 2")
GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."

NOTICES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": APACHE,
    "apache-2.0-header-short": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "apache-2.0-text": "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-text": f"{MIT}\n\n{MIT_REST}",
    "mit-grant": MIT,
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": BSD,
    "bsd-3-clause": f"{BSD}\n\n{BSD_NAME}",
    "bsd-3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": f"{GPL3}\n\n{GPL_REST}",
    "gpl-3.0-grant": GPL3,
    "gpl-2.0-header": f"{GPL2}\n\n{GPL_REST}",
    "gpl-2.0-grant": GPL2,
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "mpl-2.0-header": f"{MPL} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2.0-subject": MPL,
    "mpl-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _wrapped(text: str, width: int) -> list[str]:
    return "\n\n".join(p if "\n" in p else textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n")).split("\n")


def test_every_rule_fires_on_its_notice(spark):
    assert NOTICES.keys() == RULES.keys()
    assert all(any(s in x for s in SIGNS) or x.startswith("licensed") for x in [*SENTENCES.values(), *VARIANTS])
    rows = []
    for rule, text in NOTICES.items():
        rows.append((rule, text))
        for width in (36, 72):
            lines = _wrapped(text, width)
            rows.append((rule, "\n".join(lines)))
            rows.append((rule, "\r\n".join(lines)))
            for mark in ("# ", " * ", "// "):
                rows.append((rule, f"{mark}Copyright 2020 A\n{mark}\n" + "\n".join(mark + x for x in lines) + f"\n{mark}\nrest = 1"))
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {(r.doc_id, r.rule): r.times for r in license_scan(docs).collect()}
    assert found == {(k, rule): 1 for k, (rule, _) in enumerate(rows)}


def test_joining_loses_no_sentence(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0\nThe License file is in the root.",
        "some words\nReleased under the MIT License\nmore: Licensed under the MIT License.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.rule) for r in license_scan(docs).collect()}
    assert found == {(0, "apache-2.0-notice"), (1, "mit-licensed")}
