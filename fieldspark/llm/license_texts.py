"""Training texts of the licence classifier: short forms and characteristic passages of licence families.

Fixed values: the wording of public licences and of the notices that name them, in natural order.
"""

from __future__ import annotations

FAMILIES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This work is released under the Apache License 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GNU GPL, version 2 or later.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL, version 3.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under the Creative Commons Attribution License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved. No part of this publication may be reproduced without permission.",
        "This document is confidential and proprietary; unauthorized copying is prohibited.",
        "Unauthorized reproduction or distribution of this copyrighted work is illegal.",
    ],
}

#: Paragraphs that speak of licences, or share their words, and are none.
NONE: list[str] = [
    "He lost his driving license last year.",
    "The bar has a liquor license and closes at two.",
    "You need a fishing license to go there.",
    "The license plate of the car was muddy.",
    "The council will license new taxis.",
    "Copyright law has a long history.",
    "Software licensing is a topic of this course.",
    "The warranty on the washing machine covers two years.",
    "Their general manager speaks to the public about the version.",
    "She took poetic license with the story.",
    "The museum is open to the public under new conditions.",
    "A common attribution error in psychology.",
    "Permission to land was granted at noon.",
    "The goods are sold as is, and the buyer pays the fee.",
    "We moved the source of the river on the map.",
    "The apache helicopter flew over the valley.",
    "Students of MIT visited the laboratory.",
    "Working under the general, version of the story three was told.",
]

#: Notices of licences that have no family here: the class of unknown licences.
OTHER: list[str] = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the EUPL, version 1.2 or later.",
    "Licensed under the European Union Public Licence.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
    "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "THE BEER-WARE LICENSE (Revision 42)",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Released under the zlib license.",
    "Licensed under the Academic Free License version 3.0.",
    "This work is licensed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Open Software License version 3.0.",
    "Licensed under the Server Side Public License, version 1.",
    "Use of this source code is governed by a licence that can be found in the LICENSE file.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "The data are made available under the Open Database License.",
]
