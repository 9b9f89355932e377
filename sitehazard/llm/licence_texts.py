"""Further notices and licence texts; of long licences the opening words."""

TEXTS = {
    "AGPL": "Under the GNU Affero General Public License.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms "
    "of the GNU Affero General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0 text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND "
    'CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean '
    "the terms and conditions for use, reproduction, and distribution as defined by Sections "
    '1 through 9 of this document. "Licensor" shall mean the copyright owner or entity '
    'authorized by the copyright owner that is granting the License. "Legal Entity" shall '
    "mean the union of the acting entity and all other",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE REGENTS AND "
    "CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause name": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. 3. Neither the name of the University nor the "
    "names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
    "REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY "
    "OF SUCH DAMAGE.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
    "International License.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives "
    "4.0 International License.",
    "CC-BY-NC-ND-4.0 short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
    "International License.",
    "CC-BY-NC-SA-4.0 short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
    "International License.",
    "CC-BY-ND-4.0 short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0 short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or "
    "neighboring rights to this work.",
    "CC0-1.0 name": "Released under CC0 1.0 Universal.",
    "CC0-1.0 text": "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW "
    "FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE "
    "AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "
    '"AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT '
    "OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES "
    "RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER. "
    "Statement of Purpose The laws of most jurisdictions throughout the world automatically "
    "confer",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms "
    "of the GNU General Public License as published by the Free Software Foundation; either "
    "version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software "
    "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is "
    "permitted to copy and distribute verbatim copies of this license document, but changing "
    "it is not allowed. Preamble The licenses for most software are designed to take away "
    "your freedom to share and change it. By contrast, the GNU General Public License is "
    "intended to guarantee your freedom to share and change free software--to make sure the "
    "software is free for all its",
    "GPL-3.0 text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
    "Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute "
    "verbatim copies of this license document, but changing it is not allowed. Preamble The "
    "GNU General Public License is a free, copyleft license for software and other kinds of "
    "works. The licenses for most software and other practical works are designed to take "
    "away your freedom to share and change the works. By contrast, the GNU General Public "
    "License is intended to guarantee your freedom to",
    "ISC": "Released under the ISC License.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies.",
    "LGPL": "Under the GNU Lesser General Public License.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms "
    "of the GNU Lesser General Public License as published by the Free Software Foundation; "
    "either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1 text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 "
    "Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 "
    "USA Everyone is permitted to copy and distribute verbatim copies of this license "
    "document, but changing it is not allowed. [This is the first released version of the "
    "Lesser GPL. It also counts as the successor of the GNU Library Public License, version "
    "2, hence the version number 2.1.] Preamble The licenses for most software are designed "
    "to take away your freedom to share and",
    "LGPL-3.0 text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free "
    "Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and "
    "distribute verbatim copies of this license document, but changing it is not allowed. "
    "This version of the GNU Lesser General Public License incorporates the terms and "
    "conditions of version 3 of the GNU General Public License, supplemented by the "
    'additional permissions listed below. 0. Additional Definitions. As used herein, "this '
    'License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL"',
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in "
    'all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
    "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0 text": "Mozilla Public License Version 2.0 ================================== 1. Definitions "
    '-------------- 1.1. "Contributor" means each individual or legal entity that creates, '
    'contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" '
    "means the combination of the Contributions of others (if any) used by a Contributor and "
    'that particular Contributor\'s Contribution. 1.3. "Contribution" means Covered Software '
    'of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which the '
    "initial",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free "
    "to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
    "and by any means.",
}
