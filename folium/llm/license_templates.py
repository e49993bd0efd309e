"""License wording with template markup for operator 9: fixed values, as published, in lower-case words.

``<<beginOptional>> ... <<endOptional>>`` holds words that may be missing, ``<<var;max=N>>`` stands for up to N replaceable
words, and a place that goes on as after ``<<unless>>`` does not count. Families of notices that differ in a name or a number
are made from rules.
"""

from __future__ import annotations

from pathlib import Path

AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties
        of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or
        in connection with the software or the use or other dealings in the software"""
ISC_END = """the software is provided as is and <<var;max=6>> disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall <<var;max=6>> be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software"""
BSD_CLAUSES = """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<var;max=1>> redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer <<var;max=1>> redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution"""
BSD_END = """this software is provided by <<var;max=16>> as is and any express or implied warranties including but not limited to
        the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
        <<var;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not
        limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
        and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any
        way out of the use of this software even if advised of the possibility of such damage"""
MPL_NOTICE = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at <<var;max=8>>"""

#: Labels are licence identifiers; each has one template or more.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        """licensed under the apache license version 2 0""",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at <<var;max=8>> unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied see the license for the specific language governing permissions and limitations under the license""",
        """apache license version 2 0 january 2004 <<var;max=6>> terms and conditions for use reproduction and distribution <<beginOptional>> 1 <<endOptional>>
        definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document
        licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license legal entity shall mean the union of
        the acting entity and all other entities that control are controlled by or are under common control with that entity for the purposes of this
        definition control means i the power direct or indirect to cause the direction or management of such entity whether by contract or otherwise or ii
        ownership of fifty percent 50 or more of the outstanding shares or iii beneficial ownership of such entity you or your shall mean an individual or
        legal entity exercising permissions granted by this license source form shall mean the preferred form for making modifications including but not
        limited to software source code documentation source and configuration files object form shall mean any form resulting from mechanical transformation
        or translation of a source form including but not limited to compiled object code generated documentation and conversions to other media types work
        shall mean the work of authorship whether in source or object form made available under the license as indicated by a copyright notice that is
        included in or attached to the work an example is provided in the appendix below derivative works shall mean any work whether in source or object form
        that is based on or derived from the work and for which the editorial revisions annotations elaborations or other modifications represent as a whole
        an original work of authorship for the purposes of this license derivative works shall not include works that remain separable from or merely link or
        bind by name to the interfaces of the work and derivative works thereof contribution shall mean any work of authorship including the original version
        of the work and any modifications or additions to that work or derivative works thereof that is intentionally submitted to licensor for inclusion in
        the work by the copyright owner or by an individual or legal entity authorized to submit on behalf of the copyright owner for the purposes of this
        definition submitted means any form of electronic verbal or written communication sent to the licensor or its representatives including but not
        limited to communication on electronic mailing lists source code control systems and issue tracking systems that are managed by or on behalf of the
        licensor for the purpose of discussing and improving the work but excluding communication that is conspicuously marked or otherwise designated in
        writing by the copyright owner as not a contribution contributor shall mean licensor and any individual or legal entity on behalf of whom a
        contribution has been received by licensor and subsequently incorporated within the work <<beginOptional>> 2 <<endOptional>> grant of copyright
        license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge
        royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the
        work and such derivative works in source or object form <<beginOptional>> 3 <<endOptional>> grant of patent license subject to the terms and
        conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as
        stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work where such license applies only
        to those patent claims licensable by such contributor that are necessarily infringed by their contribution s alone or by combination of their
        contribution s with the work to which such contribution s was submitted if you institute patent litigation against any entity including a cross claim
        or counterclaim in a lawsuit alleging that the work or a contribution incorporated within the work constitutes direct or contributory patent
        infringement then any patent licenses granted to you under this license for that work shall terminate as of the date such litigation is filed
        <<beginOptional>> 4 <<endOptional>> redistribution you may reproduce and distribute copies of the work or derivative works thereof in any medium with
        or without modifications and in source or object form provided that you meet the following conditions a you must give any other recipients of the work
        or derivative works a copy of this license and b you must cause any modified files to carry prominent notices stating that you changed the files and c
        you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices from the source
        form of the work excluding those notices that do not pertain to any part of the derivative works and d if the work includes a notice text file as part
        of its distribution then any derivative works that you distribute must include a readable copy of the attribution notices contained within such notice
        file excluding those notices that do not pertain to any part of the derivative works in at least one of the following places within a notice text file
        distributed as part of the derivative works within the source form or documentation if provided along with the derivative works or within a display
        generated by the derivative works if and wherever such third party notices normally appear the contents of the notice file are for informational
        purposes only and do not modify the license you may add your own attribution notices within derivative works that you distribute alongside or as an
        addendum to the notice text from the work provided that such additional attribution notices cannot be construed as modifying the license you may add
        your own copyright statement to your modifications and may provide additional or different license terms and conditions for use reproduction or
        distribution of your modifications or for any such derivative works as a whole provided your use reproduction and distribution of the work otherwise
        complies with the conditions stated in this license <<beginOptional>> 5 <<endOptional>> submission of contributions unless you explicitly state
        otherwise any contribution intentionally submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this
        license without any additional terms or conditions notwithstanding the above nothing herein shall supersede or modify the terms of any separate
        license agreement you may have executed with licensor regarding such contributions <<beginOptional>> 6 <<endOptional>> trademarks this license does
        not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary
        use in describing the origin of the work and reproducing the content of the notice file <<beginOptional>> 7 <<endOptional>> disclaimer of warranty
        unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis
        without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non
        infringement merchantability or fitness for a particular purpose you are solely responsible for determining the appropriateness of using or
        redistributing the work and assume any risks associated with your exercise of permissions under this license <<beginOptional>> 8 <<endOptional>>
        limitation of liability in no event and under no legal theory whether in tort including negligence contract or otherwise unless required by applicable
        law such as deliberate and grossly negligent acts or agreed to in writing shall any contributor be liable to you for damages including any direct
        indirect special incidental or consequential damages of any character arising as a result of this license or out of the use or inability to use the
        work including but not limited to damages for loss of goodwill work stoppage computer failure or malfunction or any and all other commercial damages
        or losses even if such contributor has been advised of the possibility of such damages <<beginOptional>> 9 <<endOptional>> accepting warranty or
        additional liability while redistributing the work or derivative works thereof you may choose to offer and charge a fee for acceptance of support
        warranty indemnity or other liability obligations and or rights consistent with this license however in accepting such obligations you may act only on
        your own behalf and on your sole responsibility not on behalf of any other contributor and only if you agree to indemnify defend and hold each
        contributor harmless for any liability incurred by or claims asserted against such contributor by reason of your accepting any such warranty or
        additional liability""",
    ],
    "MIT": [
        """licensed under the <<beginOptional>> terms of the <<endOptional>> mit license""",
        """released under the <<beginOptional>> terms of the <<endOptional>> mit license""",
        f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or substantial portions of
        the software {AS_IS}""",
    ],
    "MIT-0": [
        f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so {AS_IS}""",
    ],
    "ISC": [
        f"""permission to use copy modify and <<beginOptional>> or <<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        {ISC_END}""",
    ],
    "0BSD": [
        f"""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        {ISC_END}""",
    ],
    "BSD-2-Clause": [f"{BSD_CLAUSES} {BSD_END}"],
    "BSD-3-Clause": [
        f"""{BSD_CLAUSES} <<var;max=1>> the name of <<var;max=8>> may not be used to endorse or promote products derived from this
        software without specific prior written permission {BSD_END}""",
        f"""{BSD_CLAUSES} <<var;max=1>> neither the name of <<var;max=12>> nor the names of <<var;max=2>> contributors may be used to
        endorse or promote products derived from this software without specific prior written permission {BSD_END}""",
    ],
    "Zlib": [
        """this software is provided as is without any express or implied warranty in no event will <<var;max=6>> be held
        liable for any damages arising from the use of this software permission is granted to
        anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
        subject to the following restrictions <<var;max=1>> the origin of this software must not be misrepresented you must not claim
        that you wrote the original software if you use this software in a product an acknowledgment in the product documentation
        would be appreciated but is not required <<var;max=1>> altered source versions must be plainly marked as such and must not be
        misrepresented as being the original software <<var;max=1>> this notice may not be removed or altered from any source
        distribution""",
    ],
    "MPL-2.0": [
        MPL_NOTICE + " <<unless>> this source code form is incompatible with secondary licenses",
        """licensed under the <<beginOptional>> terms of the <<endOptional>> mozilla public license <<beginOptional>> version
        <<endOptional>> <<beginOptional>> v <<endOptional>> 2 0""",
    ],
    "MPL-2.0-no-copyleft-exception": [MPL_NOTICE + " this source code form is incompatible with secondary licenses"],
    "Unlicense": [
        f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public
        at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law {AS_IS}""",
    ],
    "CC0-1.0": [
        """creative commons <<beginOptional>> legal code <<endOptional>> cc0 1 0 universal""",
        """cc0 1 0 <<beginOptional>> universal <<endOptional>>""",
        """the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her
        rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law""",
    ],
}


def _gnu() -> dict[str, list[str]]:
    """Notices of the GNU licences, each as this version only and as this or any later one."""
    out: dict[str, list[str]] = {}
    as_published = "<<beginOptional>> as published by the free software foundation <<endOptional>>"
    later = "or <<beginOptional>> at your option <<endOptional>> <<beginOptional>> any <<endOptional>> later"
    for name, code, versions in (("gnu general public license", "GPL", ("1", "2", "3")), ("gnu lesser general public license", "LGPL", ("2 1", "3")), ("gnu library general public license", "LGPL", ("2",)), ("gnu affero general public license", "AGPL", ("3",))):
        for v in versions:
            nought = "" if " " in v else " <<beginOptional>> 0 <<endOptional>>"
            label = f"{code}-{v.replace(' ', '.') if nought == '' else v + '.0'}"
            for number in (f"version {v}{nought}", f"v{v}{nought}"):
                for notice, rest in ((f"{name} {as_published} <<beginOptional>> either <<endOptional>> {number} <<beginOptional>> of the license <<endOptional>>", f"{as_published} {later}"), (f"{name} {number} as published by the free software foundation", later)):
                    out.setdefault(f"{label}-or-later", []).append(f"{notice} {later}")
                    out.setdefault(f"{label}-only", []).append(f"{notice} <<unless>> {rest}")
    return out


def _creative_commons() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for code, names in {"": [""], "-SA": ["sharealike", "share alike"], "-NC": ["noncommercial", "non commercial"], "-ND": ["noderivatives", "noderivs", "no derivatives"], "-NC-SA": ["noncommercial sharealike", "noncommercial share alike"], "-NC-ND": ["noncommercial noderivatives", "noncommercial noderivs"]}.items():
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"CC-BY{code}-{version.replace(' ', '.')}"
            out[label] = [f"creative commons attribution {n} {version}" for n in names] + [f"cc by {code[1:].lower().replace('-', ' ')} {version}"]
    return out


def _whole() -> dict[str, str]:
    """Whole licences, as published, a file each: what comes after the terms is optional, and so are addresses."""
    return {file.stem: file.read_text() for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


for _made in (_gnu(), _creative_commons()):
    TEMPLATES.update(_made)

#: Labels and their licences' whole text; notices within such a text are the text's, and give no label.
WHOLE: dict[str, str] = _whole()


def identifiers() -> dict[str, str]:
    """Labels by lower-case identifier, as in identifier lines: "+" stands for any later version, a bare GNU identifier for its only one."""
    labels = [*TEMPLATES, *WHOLE]
    out = {label.lower(): label for label in labels}
    out |= {label.lower().removesuffix("-only"): label for label in labels if label.endswith("-only")}
    return out | {label.lower().removesuffix("-or-later") + "+": label for label in labels if label.endswith("-or-later")}
