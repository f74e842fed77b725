"""Known licences: whole texts, one-line notices, and digests of long texts. Fixed values, public texts of the licences' authors."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so"""

_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

#: (licence, text): a unit whose canonical form equals that of a text is under the licence.
TEXTS = [
    ("MIT", f"""MIT License

Copyright (c) <year> <copyright holders>

{_MIT_GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

{_MIT_WARRANTY}"""),
    ("MIT-0", f"""MIT No Attribution

Copyright <year> <copyright holders>

{_MIT_GRANT}.

{_MIT_WARRANTY}"""),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) <year>, <owner>\n\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}"),
    ("ISC", f"""ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

{_ISC_WARRANTY}"""),
    ("0BSD", f"""BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_ISC_WARRANTY}"""),
    ("Zlib", """zlib License

(C) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]

#: (licence, SHA-256 of the canonical form) of whole texts: those of Debian's common-licenses, three of them up to the end of their terms too, and the Unlicense.
DIGESTS = [
    ("Apache-2.0", "fd5fdb9b0402d56db4fe0118fc00dc2514afcf44a4cdfc0fd9e65086981564b0"),
    ("Apache-2.0", "708631c3b385dce7932eb90e6d1bd9f0b0cef1104f74014ae43fca374b4003ce"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("GPL-1.0-only", "803e40174d2ebc5c16d980ae3628def55d10d3e8828ba7e2ebb8b477dbacb7fe"),
    ("GPL-2.0-only", "48936df8cabd5a1d8357c891cedc9f01fc84d84d5873cd736e895c9e0f4af1e7"),
    ("GPL-2.0-only", "a54553829cc70a1752ae3dae3fc8f947a29c59b4f095defcfbe8ce9c8cb85dde"),
    ("GPL-3.0-only", "e5d450eee65b3b7088759b9fb7814766e5632dd585291dec480b67de137965dd"),
    ("GPL-3.0-only", "687e35485959cebb78afc97d0ef9a10ec32b345e3f8cd24afd5093c5b6d41741"),
    ("LGPL-2.0-only", "c2932524fca00cabb6e26ef440c5802da1214d5496625c0a8faa7c538448b028"),
    ("LGPL-2.1-only", "1baa049afce6711f85dd992372e2a92e1b0073935e3e25fd74b6c79e1fd022f9"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "61c2682a4da071bed6829fa882c944634f7d717d61d31c36df7f02bbb23334d8"),
    ("MPL-2.0", "aec9be6aefb941d1b249b6a1592b711170339a501c7366f80b3040fdb1d41ef6"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "2f1ccb19e9ad7a1acc349555a439d99b5b0886acdc18a092d51fbc693c43d5c5"),
    ("GFDL-1.3-only", "dd4df7526b65872bac6a00e729dc14371661a5ba7b9afa1d4923265cd2b4efc1"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
]
