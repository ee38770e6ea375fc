"""Licences whose canonical texts are looked up. (name, whole text or notice.)"""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

LICENCES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

#: Words that licences begin with, after a copyright statement.
FIRST_WORDS = (
    "permission is hereby granted",
    "permission to use",
    "redistribution and use",
    "this software is provided",
    "this program is free software",
    "this library is free software",
    "everyone is permitted to copy",
    "licensed under",
    "released under",
)

#: Long licences by name, canonical length and digest of the whole text, as published
#: and with all of it on one line. Made with ``canonical`` from the published texts.
LONG_LICENCES: list[tuple[str, int, str]] = [
    ("Apache-2.0", 9881, "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", 9920, "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Artistic-1.0-Perl", 5767, "218f1ec4421d86ea2a33c8d48d59a4353610d9d5d10fb755982e50a5dad1e04b"),
    ("Artistic-1.0-Perl", 5823, "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", 6621, "85fe8c5f6c898b7b7bdfb62efa4192f21f8c92b0d94d318e4a52dc7de615fc93"),
    ("GFDL-1.2", 19556, "c75e8367a4b568396b582aaba25494244e9a21fc27ddda82fc2762a5b92cbb9b"),
    ("GFDL-1.2", 19581, "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", 21982, "ca80d4b4c89f82068ce01367bb671736f4ed5c454130cee71fef8167abe3db2b"),
    ("GFDL-1.3", 21996, "9a90b1bf6c45e9b008c5516a6910f8bb34ea74ff605fb5f3ac9c82ecb9e73df7"),
    ("GPL-1.0", 11742, "94dd0dee0896b27fc57ab4d286eee73a522a27f822d98b01787ef603a3ee1f9e"),
    ("GPL-1.0", 11762, "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", 17089, "d224f0c40904986bb1f29c2492c57b7e55e5a96791f8ca0074be2206f56af3fe"),
    ("GPL-2.0", 17113, "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", 33325, "f261b435eb8567cdf85af2d75ff64fc410ffd6736a25e4e3decf53444c84954b"),
    ("GPL-3.0", 33427, "9171ac452a97999a447405598568f4e230127eb5aa145d350816f05fe44436d7"),
    ("LGPL-2.0", 24102, "62186ed46549a4e53bae63e5718c055e445c5968d7e66ee478d38d3d53e302bb"),
    ("LGPL-2.0", 24126, "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", 25189, "4255f7c1e2a0f543f157083a1fd4b7e4208f5faf98157d2a6de1c0ecca60b9a0"),
    ("LGPL-2.1", 25213, "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22467, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

#: Spellings that count as equal, after case and punctuation are gone.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub licence", "sublicense"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("creative commons", "cc"),
    ("attribution noncommercial", "by nc"),
    ("https", "http"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
]
