"""Standard licence texts and notices, by SPDX identifier. Names, years and holders are left out."""

#: Identifiers that a file's SPDX line may name.
IDENTIFIERS = [
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "CDDL-1.0", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GFDL-1.3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Unlicense", "UPL-1.0", "WTFPL", "Zlib",
]

#: Sentences by which texts name their licence.
SENTENCES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "licensed under the Apache License 2.0", "licensed under the Apache 2.0 License", "Distributed under the Apache License, Version 2.0"],
    "MIT": [
        "Released under the MIT License.", "The MIT License (MIT)", "licensed under the MIT License - see the LICENSE file for details", "This project is licensed under the MIT License", "distributed under the terms of the MIT license",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "licensed under the BSD 3-Clause License"],
    "BSD-2-Clause": ["licensed under the BSD 2-Clause License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This project is licensed under the GNU General Public License v3.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This file is subject to the terms and conditions of the GNU General Public License version 2",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "made available under the terms of the Eclipse Public License v. 2.0",
    ],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"],
}
for _name in IDENTIFIERS:
    SENTENCES.setdefault(_name, []).append(f"SPDX-License-Identifier: {_name}")

_GNU_TERMS = "either version {v} of the License, or (at your option) any later version."
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License "
    "as published by the Free Software Foundation, " + _GNU_TERMS + " This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name}General Public License for more details."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Whole licence texts, or the notice that a licence asks to be put into each file.
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-2-Clause": [_BSD_START + _BSD_END],
    "BSD-3-Clause": [_BSD_START + _BSD_NAME + _BSD_END, _BSD_NAME],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "GPL-2.0": [
        _GNU.format(name="", v="2"),
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to "
        "guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ],
    "GPL-3.0": [
        _GNU.format(name="", v="3"),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are "
        "designed to take away your freedom to share and change the works.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "LGPL-3.0": [
        _GNU.format(name="Lesser ", v="3"),
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, "
        "supplemented by the additional permissions listed below.",
    ],
    "AGPL-3.0": [
        _GNU.format(name="Affero ", v="3"),
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation "
        "with the community in the case of network server software.",
    ],
    "OFL-1.1": [
        "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font creation efforts of "
        "academic and linguistic communities, and to provide a free and open framework in which fonts may be shared and improved in partnership with others.",
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "PostgreSQL": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, "
        "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ],
    "Artistic-2.0": [
        "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. "
        "The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty.",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator "
        "and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
}
