"""Licence texts in the forms in which they are found: short ones entire, long ones as standard headers and as digests of the whole."""

from __future__ import annotations

import itertools

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)


def _bsd():
    for numbered, holder, name in itertools.product((True, False), ("HOLDER", "HOLDERS", "OWNER"), (None, "the copyright holder", "the copyright holders")):
        clauses = [_BSD[1], _BSD[2], *([_BSD[3].format(name=name)] if name else [])]
        clauses = [f"{i}. {c}" if numbered else c for i, c in enumerate(clauses, 1)]
        yield f"BSD-{len(clauses)}-Clause", "\n".join([_BSD[0], *clauses, _BSD[4].format(holder=holder)])


def _gnu():
    for name, spdx, versions in (("GNU General Public License", "GPL", "23"), ("GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("GNU Affero General Public License", "AGPL", "3")):
        for v, what, later, end in itertools.product(versions, ("program", "library"), (True, False), (
            "You should have received a copy of the {n} along with this {w}. If not, see <https://www.gnu.org/licenses/>.",
            "You should have received a copy of the {n} along with this {w}; if not, see <https://www.gnu.org/licenses/>.",
            "You should have received a copy of the {n} along with this {w}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        )):
            under = f"either version {v} of the License, or (at your option) any later version." if later else f"version {v} of the License."
            yield f"{spdx}-{v if '.' in v else v + '.0'}", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {under}\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n" + end.format(n=name, w=what)


def _creative_commons():
    for spdx, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial")):
        first = f"This work is licensed under the Creative Commons {name} 4.0 International License."
        yield f"CC-{spdx}-4.0", first
        yield f"CC-{spdx}-4.0", f"{first} To view a copy of this license, visit http://creativecommons.org/licenses/{spdx.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."


_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: Fixed values: (licence, text), without title and copyright lines.
TEXTS = (
    *_bsd(), *_gnu(), *_creative_commons(), ("Apache-2.0", _APACHE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
