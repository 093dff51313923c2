"""Wordings of licences as they are printed, by SPDX identifier."""

from __future__ import annotations

# Names and titles, notices, and paragraphs that tell a licence from the others.
TEXTS = {
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "Artistic-2.0": [
        "The Artistic License 2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0).",
        "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "BSD 3-Clause License",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "The author has dedicated the work to the public domain by waiving all rights under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "Creative Commons Legal Code CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CDDL-1.0": [
        "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "EPL-2.0": [
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "ISC License",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "OFL-1.1": [
        "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: https://scripts.sil.org/OFL",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions:",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "PostgreSQL": [
        "Released under the PostgreSQL License.",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
        "SPDX-License-Identifier: PostgreSQL",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright notice: all rights reserved. No part of this publication may be reproduced without written permission.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential copyright.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004", "Licensed under the WTFPL.", "SPDX-License-Identifier: WTFPL"],
    "Zlib": [
        "zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source distribution; warranty permission.",
        "SPDX-License-Identifier: Zlib",
    ],
}

# Short names under which notices and expressions speak of a licence.
NAMES = {
    "AGPL-3.0": ["AGPL-3.0", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL version 3"],
    "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache 2.0"],
    "Artistic-2.0": ["Artistic-2.0", "Artistic License 2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "3-Clause BSD License", "New BSD License"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0-1.0"],
    "CDDL-1.0": ["CDDL-1.0"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0"],
    "GPL-2.0": ["GPL-2.0", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL version 2"],
    "GPL-3.0": ["GPL-3.0", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later", "GPL version 3"],
    "ISC": ["ISC"],
    "LGPL-2.1": ["LGPL-2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT", "MIT License"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0"],
    "OFL-1.1": ["OFL-1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["Zlib", "zlib License"],
}

# What of a family's texts another family's licence holds word for word: (family, how a shared text begins, the
# other family, how texts begin that the other has all of, how a text begins that only the first has).
SHARED = [
    ("BSD-3-Clause", ["Redistribution and use in source", "Redistributions of source code", "Redistributions in binary form", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT"], "BSD-2-Clause", ["Redistributions of source code", "Redistributions in binary form"], ["Neither the name"]),
]

# Sentences that speak of licences, rights and the like, and name no licence.
OTHERS = [
    "See the LICENSE file for details.",
    "Please read the license before you install the software.",
    "A driving license is required.",
    "A licence to fish in the lake can be had from the town hall.",
    "The license plate was new.",
    "She was licensed to teach.",
    "The bar lost its liquor license after the second warning.",
    "Drivers must renew their licence every ten years.",
    "This version is free.",
    "Released under his own name.",
    "The record was released under a small label.",
    "General rules for public use.",
    "Version 2 was released in May.",
    "Version 3 of the form must be signed by both parties.",
    "The commons by the river.",
    "A creative common room for the students.",
    "Rights and duties of the public.",
    "All seats had been reserved and all rights of way respected.",
    "The house of commons debated copyright reform.",
    "Copyright law protects authors.",
    "The copyright of the photograph is disputed.",
    "Copyright 2014 by the author.",
    "He asked for permission to leave and it was granted.",
    "Permission was granted by the owner.",
    "The warranty covers two years.",
    "The lamp comes with a warranty of one year and free repair.",
    "Terms and conditions apply to this work.",
    "The author may be found under this address.",
    "Use of this file is free.",
    "Redistribution of wealth and power in the provinces.",
    "The apache tribes lived in the south.",
    "Mozilla and its public image.",
    "The general public was invited by the foundation.",
    "The software is provided with a manual and a charger.",
    "The public domain of the old kings was sold.",
    "A table reserved for the conditions of the following night.",
    "The eclipse was seen by the general public.",
    "The institute at the river bank met again.",
]
