"""Public notices, names and usual phrases of licence families, from which the classifier is trained.

Fixed values: names of the families and the wording that their notices have in public use.
"""

from __future__ import annotations

NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Distributed under the MIT License. See LICENSE for more information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "This software is distributed under the 3-clause BSD license.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "This project is licensed under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0.",
        "Released under the GPL, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is licensed under the LGPL v3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation.",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under Creative Commons Attribution 3.0.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License v2.0 which accompanies this distribution.",
    ),
    "Boost": (
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "This work is dedicated to the public domain.",
    ),
    "Reserved": (
        "All rights reserved.",
        "Copyright 2020 Example Corp. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
# How the families are named; a name counts in the phrases below, never by itself.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "MIT License", "the MIT license", "the MIT License (MIT)", "The MIT License", "MIT/X11", "Expat license"),
    "BSD": (
        "BSD", "BSD license", "the BSD License", "BSD-2-Clause", "BSD-3-Clause", "BSD 3-Clause License",
        "3-clause BSD license", "2-clause BSD", "New BSD license", "the Simplified BSD License", "modified BSD",
    ),
    "Apache": (
        "Apache-2.0", "Apache 2.0", "Apache License 2.0", "the Apache License, Version 2.0", "the Apache License",
        "Apache 2", "Apache License v2", "the Apache Software License", "Apache v2.0", "Apache 2.0 license",
    ),
    "GPL": (
        "GPL", "the GPL", "GPLv2", "GPLv3", "GPL-2.0-only", "GPL-3.0-or-later", "GPL-3.0", "GNU GPL v3", "the GNU GPL",
        "GPL v2", "GPL version 3", "GPL version 2 or later", "GNU GPLv3", "the GNU General Public License", "GNU General Public License v3.0",
        "the GNU General Public License version 2",
    ),
    "LGPL": (
        "LGPL", "the LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1-only", "LGPL-3.0-or-later", "LGPL v3", "LGPL version 2.1", "GNU LGPL", "the GNU LGPL v3",
        "the GNU Lesser General Public License", "GNU Lesser General Public License v2.1", "GNU Library General Public License",
    ),
    "AGPL": (
        "AGPL", "the AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL v3", "AGPL version 3", "GNU AGPL", "the GNU AGPL v3",
        "the GNU Affero General Public License", "GNU Affero General Public License v3.0",
    ),
    "MPL": (
        "MPL", "MPL-2.0", "MPL 2.0", "the MPL", "MPL v2.0", "the Mozilla Public License", "Mozilla Public License 2.0",
        "the Mozilla Public License, Version 2.0",
    ),
    "CC-BY": (
        "CC-BY-4.0", "CC BY 4.0", "CC-BY", "CC BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License",
        "a Creative Commons Attribution 4.0 International License", "CC BY license",
    ),
    "CC-BY-SA": (
        "CC-BY-SA-4.0", "CC BY-SA 4.0", "CC-BY-SA", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0",
        "Creative Commons Attribution-ShareAlike License", "a Creative Commons Attribution-ShareAlike 3.0 License",
    ),
    "CC-BY-NC": (
        "CC-BY-NC-4.0", "CC BY-NC 4.0", "CC-BY-NC", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC-BY-NC-ND-4.0", "CC BY-NC-ND 3.0",
        "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike License",
        "a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 License",
    ),
    "ISC": ("ISC", "ISC License", "the ISC license"),
    "EPL": ("EPL-2.0", "EPL 2.0", "EPL-1.0", "EPL v1.0", "the Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0"),
    "Boost": ("BSL-1.0", "the Boost Software License", "Boost Software License 1.0", "Boost License"),
    "Public domain": (
        "CC0", "CC0-1.0", "CC0 1.0", "the Unlicense", "Unlicense", "CC0 1.0 Universal", "Creative Commons Zero", "the CC0 license", "public domain dedication",
    ),
}
# Phrases that licence names stand in; "{}" is the name.
PHRASES: tuple[str, ...] = (
    "SPDX-License-Identifier: {}", "// SPDX-License-Identifier: {}", "License: {}", "Licence: {}", "license = {}", "\"license\": \"{}\",",
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under {}.",
    "Distributed under the terms of {}.", "This project is licensed under {}.", "This project is licensed under the terms of {}.",
    "This software is released under {}, see LICENSE for details.", "The code is available under {}.", "Published under {}.",
    "Use, copying and distribution are subject to {}.", "Code licensed under {}.", "Copyright (c) 2019 The Authors. Licensed under {}.",
    "You can redistribute it under the terms of {}.", "Available under the {} license.", "It is covered by the {} license.",
    "{}-licensed software.", "Everything in this folder is {} licensed.",
    "Source code is under {}.", "This library is free software under {}.", "It is made available under {}, as is.",
)
# Phrases of two names.
DOUBLE_PHRASES: tuple[str, ...] = (
    "Dual licensed under {} and {}.", "Licensed under either {} or {} at your option.", "Licensed under {} or {}.",
    "SPDX-License-Identifier: {} OR {}", "License: {} / {}", "Code is under {}, documentation under {}.", "Dual-licensed: {} and {}", "{} or {}", "Licensed as {} or {}.",
)
# Wording that is near to a notice without being one.
OTHER: tuple[str, ...] = (
    "He studied physics at MIT before moving to Boston.",
    "The MIT Press published the book last spring.",
    "Researchers from MIT and the city found a new method.",
    "The Apache helicopter landed near the base.",
    "The Apache web server was started again.",
    "An Apache village stood by the river.",
    "The BSD socket was closed by the other side.",
    "The GPL compiler pass removes dead code.",
    "ISC results were shown in the report.",
    "The boost in sales came from a new license of the brand.",
    "The solar eclipse was a public event.",
    "The driver has a license, version and all.",
    "Licensed under a contract with the team.",
    "Licensed and insured plumbers in your area.",
    "License: see the contract.",
    "The general public was let in for free.",
    "The creative commons of the town is a garden.",
    "A public domain name was registered by the firm.",
    "The library gave attribution to the author.",
    "Permission is needed to copy the book.",
    "All rights of the author are described in the law.",
    "The report was made available under the terms of the treaty.",
    "It was distributed under the old roof, version 2.0 of the plan.",
    "Available under the counter.",
    "This project is licensed by the council.",
    "A driving license is needed to rent a car.",
    "The license of the bar was renewed by the city.",
    "He worked under the general manager of the public library.",
    "The terms of the agreement were not met by the company.",
    "The software is written in a free style and can be used by any person.",
    "See the following list of conditions for the work in the public garden.",
    "Released under the new label, the album sold well.",
    "This work is part of a larger project.",
    "You may obtain a copy of the book at the library.",
    "The rights of the author are part of the law.",
    "This project is about the version of the story that was found.",
    "Permission to land was granted by the tower.",
)
