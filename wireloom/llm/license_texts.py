"""Notices by which public licences are named, granted or quoted, and texts that only sound like them."""

from __future__ import annotations

#: Names and identifiers of licences, by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL version 3", "AGPL-3.0", "AGPL-3.0-or-later", "AGPL-3.0-only"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License"],
    "artistic": ["Artistic License 2.0", "Artistic-2.0", "Perl Artistic License"],
    "boost": ["Boost Software License, Version 1.0", "BSL-1.0", "Boost Software License"],
    "bsd": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license", "3-clause BSD license", "2-clause BSD license", "New BSD License"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero v1.0 Universal"],
    "epl": ["Eclipse Public License 2.0", "EPL-2.0", "Eclipse Public License v1.0", "EPL-1.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPL-3.0-or-later", "GPL-2.0-only", "GPL version 2 or later", "GPLv3", "GPL-3.0"],
    "isc": ["ISC License", "ISC license"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "LGPL-2.1", "LGPL-3.0-or-later", "GNU LGPL"],
    "mit": ["MIT License", "MIT license", "Expat License"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License Version 1.1"],
    "unlicense": ["Unlicense", "Unlicense license"],
    "zlib": ["zlib License", "zlib/libpng License"],
}
#: Short identifiers that stand alone after a tag.
TAGS = {
    "agpl": ["AGPL-3.0", "AGPL-3.0-only"], "apache": ["Apache-2.0"], "artistic": ["Artistic-2.0"], "boost": ["BSL-1.0"], "bsd": ["BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-nc-sa": ["CC-BY-NC-SA-4.0"], "cc-by-nd": ["CC-BY-ND-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"],
    "epl": ["EPL-2.0", "EPL-1.0"], "gpl": ["GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0", "GPL-3.0", "GPL"], "isc": ["ISC"], "lgpl": ["LGPL-2.1", "LGPL-3.0", "LGPL"],
    "mit": ["MIT"], "mpl": ["MPL-2.0"], "unlicense": ["Unlicense"], "zlib": ["Zlib"],
}
#: How a name or a tag is put.
NAME_FRAMES = ["licensed under the {}", "released under the {}", "distributed under the terms of the {}", "this work is licensed under a {}", "licensed under {}", "available under the {}"]
TAG_FRAMES = ["SPDX-License-Identifier: {}", "License: {}", "license = {}"]
#: Paragraphs of the licences' own texts and of the notices that they ask for.
TEXTS = {
    "agpl": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "artistic": ["This program is free software; you may redistribute it and/or modify it under the same terms as Perl itself."],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "gpl": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "lgpl": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to the Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
#: Paragraphs that share words with licences and name none of the families.
OTHERS = [
    "he lost his driving license last year",
    "the license fee is due in the second quarter",
    "a copy of the report was released to the public",
    "software version 2.0 was released under great pressure",
    "the general public is free to use the park without permission",
    "licensed under the new regime the taxi drivers went on strike",
    "all rights reserved no part of this book may be reproduced without the prior written permission of the publisher",
    "copyright 2020 the authors",
    "this work is under review by the foundation",
    "the terms and conditions of the contract are met",
    "mit students released a new version of the code",
    "the apache helicopter version is subject to export conditions",
    "creative work is common in the public domain of ideas",
    "please see the license for details",
    "this software is licensed to you under the end user license agreement and not sold",
    "you may install one copy of the software on a single computer subject to the terms of this agreement",
    "the bar was licensed to sell beer and wine",
    "a fishing license is required and may be bought at the post office",
    "permission to enter was granted by the mayor",
    "the warranty covers parts and labor for two years from the date of purchase",
    "copyright law grants authors exclusive rights to their works",
    "proprietary and confidential unauthorized copying of this file is strictly prohibited",
    "licensed under the terms of the server side public license",
    "the company published its annual report under a new public format",
    "by using this website you agree to the terms of service and the privacy policy",
    "redistribution of wealth was permitted provided that the council agreed",
    "the university license office handles patents",
    "this license terminates automatically if you fail to pay",
]
