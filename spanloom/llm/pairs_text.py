"""Phrases of the pair rules, as regular expressions that ignore case. Fixed values."""

#: Labels that hold no answer by themselves, between blanks, after dropping all but letters and digits.
LABELS = (
    r"(?<= )(?:the final answer is|final answer|the answer is|answer|response|result|solution|output|assistant|reasoning|thinking|think|thought|antwort|lösung|ergebnis|die antwort ist|"
    r"respuesta|la respuesta es|réponse|la réponse est|resposta|a resposta é|risposta|la risposta è|antwoord|het antwoord is|ответ|відповідь|答案是|答案|回答|答えは|答え|정답|답은|답|उत्तर|الجواب|الإجابة|คำตอบคือ|คำตอบ)(?= )"
)

#: Words that stand for no answer, alone.
EMPTY_WORDS = (
    r"\A(?:null|none|n a|na|nan|nil|undefined|empty|blank|tbd|tba|todo|missing|no answer|no response|no output|no content|not available|not applicable|unanswered|"
    r"placeholder|your answer here|answer here|insert answer(?: here)?|x{2,}|lorem ipsum|leer|vide|vacío|vacio|vazio|vuoto|leeg|пусто|无|空|なし|없음)\z"
)

#: A stated answer.
ANSWERED = (
    r"\\boxed\{[^{}\n]+\}|(?:answer|antwort|respuesta|réponse|resposta|risposta|antwoord|ответ|відповідь|答案|答え|답|उत्तर|الجواب|คำตอบ)[^\p{L}\p{N}\n]{0,6}"
    r"(?:(?:is|ist|lautet|es|est|é|è|は|是|은|คือ|هو)[^\p{L}\p{N}\n]{0,5})?(?:\p{N}|[A-E](?![\p{L}]))|\bas the result\b|^\s*hence \p{N}+"
)

#: Ways of declining, in lower case with straight apostrophes: for each group of languages the parts one of which its
#: texts must hold, and the phrases.
REFUSALS: dict[str, tuple[str, str]] = {
    "en": (
        "not able to|unable to|not permitted to|not allowed to|i can't |i cannot |i can not |i won't |i will not |i must not |i may not |i could not |i am going to have to |not something |decline|refuse|to pass on|rather not |prefer not |outside|beyond|"
        "my rules|my guidelines|my polic|my instructions|my principles|our rules|our guidelines|our polic|our instructions|our principles|leave |leaving |no answer|no solution|no response|no help|against my |as an ai|as an assistant|as an language model",
        "|".join(
            [
                r"\bi(?:'m| am) (?:not able|unable|not permitted|not allowed) to (?!divide|find|see|tell)\w+",
                r"\bi (?:can't|cannot|can not|won't|will not|must not|may not|could not|am going to have to) (?:help|assist|answer|provide|comply|fulfil|fulfill|continue|do that|do this|respond|solve|complete|discuss|engage|share|offer)",
                r"\bnot something (?:i|that i) (?:can|could|am able to|will)\b",
                r"\b(?:have|need|going|obliged|forced) to (?:decline|refuse|pass on)|\bi (?:must|respectfully|politely|will)? ?(?:decline|refuse)\b",
                r"\b(?:rather|prefer) not (?:to )?(?:give|provide|answer|respond|help|say|solve|do)\b",
                r"\b(?:outside|beyond) (?:of )?(?:what|the scope|my)\b[^.]{0,40}\b(?:permitted|allowed|can|scope|able|abilities|guidelines|help|remit)",
                r"\b(?:my|our) (?:rules|guidelines|policy|policies|instructions|principles) (?:keep|prevent|forbid|stop|do not|don't|prohibit|bar)",
                r"\b(?:leave|leaving) (?:this|that|it)?(?: one)? ?(?:i will leave )?to (?:the|an|some)?\s?(?:experts?|professionals?|others|someone)|one i will leave to",
                r"\bno (?:answer|solution|response|help) (?:will come|is coming|can be given|will be given|shall|from me)",
                r"\bagainst my (?:guidelines|rules|policy|policies)|\bas an (?:ai|assistant|language model)[^.]{0,40}\b(?:can't|cannot|unable|not able|won't)",
            ]
        ),
    ),
    "de": (
        "nicht|keine|kein|ablehnen|verweigern|außerhalb",
        "|".join(
            [
                r"(?:kann|darf|möchte|werde) (?:ich )?(?:dir |ihnen |euch )?(?:dabei |hierbei |diese |dazu |das |diesen )?(?:leider )?(?:nicht|keine|kein)[^.]{0,40}(?:helfen|beantworten|lösen|antwort|unterstützen|weiterhelfen|behilflich|geben)",
                r"(?:muss|möchte) ich (?:leider )?(?:ablehnen|verweigern)|(?:anfrage|aufgabe|frage|bitte)[^.]{0,20}(?:muss|möchte) ich[^.]{0,20}ablehnen|nicht erlaubt|ablehnen\b|außerhalb dessen, was ich",
            ]
        ),
    ),
    "fr": (
        "je ne|dépasse|je dois|je préf|je refuse|permis|il m'est",
        "|".join(
            [
                r"je ne (?:peux|puis|suis|saurais|souhaite|vais|dois)\s?(?:pas)?[^.]{0,30}(?:répondre|aider|fournir|résoudre|donner|traiter|autorisé|en mesure|habilité|assister)",
                r"dépasse ce que j'ai le droit|je (?:dois|préfère) (?:refuser|décliner|m'abstenir)|je refuse|ne m'est pas permis|il m'est (?:interdit|impossible)",
            ]
        ),
    ),
    "es": (
        "no puedo|no podr|no debo|no me es|no soy capaz|no estoy autoriz|no se me permite|me niego a|debo |prefiero no|tengo que ",
        "|".join(
            [
                r"no (?:puedo|podré|podría|debo|me es posible|soy capaz de|estoy autorizad[oa] (?:a|para))\s(?:\w+ )?(?:ayudar|responder|contestar|resolver|dar|proporcionar|asistir|atender|con)",
                r"no me está permitido|no se me permite|debo (?:negarme|rechazar|declinar)|me niego a|prefiero no (?:responder|contestar|dar)|tengo que (?:rechazar|declinar|negarme)",
            ]
        ),
    ),
    "pt": (
        "não|recus|prefiro",
        "|".join(
            [
                r"não (?:posso|consigo|poderei|devo|me é possível|estou autorizad[oa] a)\s(?:\w+ )?(?:ajudar|responder|resolver|fornecer|dar|atender|auxiliar)",
                r"não me é permitido|não tenho permissão|devo recusar|tenho de recusar|tenho que recusar|preciso recusar|recuso-me|prefiro não responder",
            ]
        ),
    ),
    "it": (
        "non |rifiut|devo|preferisco|al di",
        "|".join(
            [
                r"non (?:posso|sono in grado di|mi è possibile|potrò|devo)\s(?:\w+ )?(?:aiutar\w*|rispondere|risolvere|fornire|dare|assister\w*)",
                r"non mi è (?:permesso|consentito)|devo (?:rifiutare|declinare|rifiutarmi)|mi rifiuto|preferisco non rispondere|al di là di ciò che mi è",
            ]
        ),
    ),
    "nl": (
        "niet|geen|moet",
        "|".join(
            [
                r"(?:kan|mag|wil|zal) (?:ik )?(?:je |u |jou )?(?:hier |hierbij |daar |daarbij |deze |dit )?(?:helaas )?(?:niet|geen)[^.]{0,40}(?:helpen|beantwoorden|oplossen|antwoord|meehelpen|bijstaan|geven)",
                r"moet (?:ik )?[^.]{0,30}(?:weigeren|afwijzen)|niet toegestaan",
            ]
        ),
    ),
    "ru, uk": (
        "",
        "|".join(
            [
                r"(?:я )?не (?:могу|смогу|буду|вправе|имею права|должен|должна)\s[^.]{0,30}(?:помочь|помогать|ответить|отвечать|решить|решать|дать|выполнить|предоставить)",
                r"вынужден[аы]? (?:отказать|отклонить)|должен отказать|мне не (?:разрешено|позволено)|отказываюсь|выходит за рамки|выходит за пределы",
                r"(?:я )?не (?:можу|зможу|буду|маю права|повинен|повинна)\s[^.]{0,30}(?:допомогти|допомагати|відповісти|відповідати|розв'язати|дати|виконати|надати)",
                r"змушен(?:ий|а) (?:відмовити|відхилити)|мушу відмовити|мені не (?:дозволено|можна)|відмовляюся|виходить за межі",
            ]
        ),
    ),
    "zh, ja, ko": (
        "",
        "|".join(
            [
                r"(?:无法|不能|不便|没法|不可以|拒绝)(?:为您|为你|给您|给你|协助|帮助|帮您|帮你|继续)?(?:回答|提供|完成|协助|解答|帮助|帮忙|满足|处理|讨论|给出)|超出了?(?:我|我的)?[^。]{0,8}(?:范围|权限|能力)|(?:我)?(?:必须|只能|不得不|需要)(?:拒绝|谢绝)|恕(?:我)?(?:不能|无法|难)|不被允许",
                r"(?:お答え|回答|お手伝い|お力になる|解答|対応|協力|支援|提供)(?:すること)?(?:は|が|を)?(?:いた|致)?(?:できません|できかね|できない|しかねます|しません|控え|差し控え|お断り)|お断り|許可されていません|許されていません|範囲を超え|答えることができ(?:ません|ない)|答えられません|辞退",
                r"(?:도와|도움을|답변|답을|대답|해결|풀어|제공|응답)[^.]{0,16}(?:없습니다|못합니다|않겠습니다|불가능|어렵습니다)|거절|거부해야|허용되지 않|허락되지 않|범위를 벗어",
            ]
        ),
    ),
    "ar, hi, th": (
        "",
        "|".join(
            [
                r"(?:لا (?:أستطيع|يمكنني|أقدر|يسعني|يُسمح لي|يسمح لي)|لست قادر[اًة]*|لن (?:أتمكن|أستطيع|أقدم|أجيب))|(?:يجب|علي|عليّ|مضطر)[^.]{0,12}(?:أرفض|الرفض|أعتذر|الاعتذار)|غير مسموح لي|يتجاوز (?:ما|حدود|نطاق)|أعتذر عن|أرفض",
                r"(?:मदद|सहायता|उत्तर|जवाब|हल|समाधान)[^।]{0,24}(?:नहीं (?:कर|दे|सकता|सकती|सकूँगा|सकूंगा)|असमर्थ)|अनुमति नहीं|मना कर(?:ना|ता|ती)|अस्वीकार|दायरे से बाहर|सीमा से बाहर|असमर्थ हूँ",
                r"(?:ไม่สามารถ|ไม่อาจ|ไม่ขอ|ขอไม่|มิอาจ)[^.]{0,20}(?:ช่วย|ตอบ|ให้คำตอบ|แก้|ดำเนินการ|ให้ข้อมูล)|ขอปฏิเสธ|ต้องปฏิเสธ|ไม่ได้รับอนุญาต|เกินขอบเขต|นอกเหนือ",
            ]
        ),
    ),
}
