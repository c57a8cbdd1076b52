"""Plain seed text of the seven languages: the first dictionaries, before labelled rows refine them."""

from __future__ import annotations

SEEDS = {
    "en": (
        "there is no reason why you should not be able to do this with what you have. "
        "it was one of the first things that they had to find out before the others could begin. "
        "we think that most people would like to know how much of it has been used and where it came from. "
        "please tell me which one is better, because I am not sure about that and need some help with the work. "
        "after the second week she said that only a few of them were really good, but he did not agree. "
        "can you explain what happens when the house is open and all the children go into the garden? "
        "some of these questions should have been asked a long time ago by those who knew the answer. "
        "this is about the new plan, and the other notes say that it will be more than enough for the year."
    ),
    "es": (
        "no hay ninguna razón por la que usted no pueda hacer esto con lo que tiene. "
        "fue una de las primeras cosas que tuvieron que averiguar antes de que los demás pudieran empezar. "
        "creemos que la mayoría de la gente quiere saber cuánto se ha usado y de dónde viene todo eso. "
        "por favor, dime cuál es mejor, porque no estoy seguro de ello y necesito ayuda con el trabajo. "
        "después de la segunda semana ella dijo que solo algunos de ellos eran muy buenos, pero él no estaba de acuerdo. "
        "¿puedes explicar qué pasa cuando la casa está abierta y todos los niños van al jardín? "
        "algunas de estas preguntas deberían haberse hecho hace mucho tiempo por quienes sabían la respuesta. "
        "se trata del nuevo plan, y las otras notas dicen que será más que suficiente para este año. hubo también muchas."
    ),
    "pt": (
        "não há nenhuma razão para que você não possa fazer isto com o que tem. "
        "foi uma das primeiras coisas que eles tiveram de descobrir antes que os outros pudessem começar. "
        "achamos que a maioria das pessoas quer saber quanto foi usado e de onde vem tudo isso. "
        "por favor, diga-me qual é melhor, porque não tenho certeza e preciso de ajuda com o trabalho. "
        "depois da segunda semana ela disse que só alguns deles eram muito bons, mas ele não concordou. "
        "você pode explicar o que acontece quando a casa está aberta e todas as crianças vão ao jardim? "
        "algumas destas perguntas deveriam ter sido feitas há muito tempo por quem sabia a resposta. "
        "trata-se do novo plano, e as outras notas dizem que será mais do que suficiente para este ano. houve também muitas."
    ),
    "fr": (
        "il n'y a aucune raison pour que vous ne puissiez pas faire cela avec ce que vous avez. "
        "c'était une des premières choses qu'ils ont dû trouver avant que les autres puissent commencer. "
        "nous pensons que la plupart des gens veulent savoir combien on en a utilisé et d'où cela vient. "
        "dites-moi s'il vous plaît lequel est le meilleur, car je n'en suis pas sûr et j'ai besoin d'aide pour le travail. "
        "après la deuxième semaine, elle a dit que seuls quelques-uns étaient vraiment bons, mais il n'était pas d'accord. "
        "pouvez-vous expliquer ce qui se passe quand la maison est ouverte et que tous les enfants vont dans le jardin ? "
        "certaines de ces questions auraient dû être posées il y a longtemps par ceux qui savaient la réponse. "
        "il s'agit du nouveau plan, et les autres notes disent que ce sera plus que suffisant pour cette année."
    ),
    "de": (
        "es gibt keinen grund, warum sie das nicht mit dem machen können, was sie haben. "
        "es war eines der ersten dinge, die sie herausfinden mussten, bevor die anderen anfangen konnten. "
        "wir glauben, dass die meisten leute wissen wollen, wie viel davon benutzt wurde und woher es kommt. "
        "bitte sag mir, welches besser ist, denn ich bin mir nicht sicher und brauche etwas hilfe bei der arbeit. "
        "nach der zweiten woche sagte sie, dass nur wenige von ihnen wirklich gut waren, aber er war nicht einverstanden. "
        "kannst du erklären, was passiert, wenn das haus offen ist und alle kinder in den garten gehen? "
        "einige dieser fragen hätten schon vor langer zeit von denen gestellt werden sollen, die die antwort kannten. "
        "es geht um den neuen plan, und laut den anderen notizen wird es mehr als genug für dieses jahr sein."
    ),
    "ru": (
        "нет никакой причины, почему вы не могли бы сделать это с тем, что у вас есть. "
        "это было одно из первых дел, которое они должны были выяснить, прежде чем остальные смогли начать. "
        "мы думаем, что большинство людей хочет знать, сколько было использовано и откуда всё это взялось. "
        "пожалуйста, скажите мне, что лучше, потому что я не уверен и мне нужна помощь с работой. "
        "после второй недели она сказала, что только немногие из них были очень хороши, но он не согласился. "
        "можете ли вы объяснить, что происходит, когда дом открыт и все дети идут в сад? "
        "некоторые из этих вопросов надо было задать уже давно тем, кто знал ответ. "
        "речь идёт о новом плане, и другие заметки говорят, что этого будет более чем достаточно на этот год."
    ),
    "zh": (
        "没有任何理由说明你不能用你现有的东西来做这件事。这是他们必须首先弄清楚的事情之一，然后其他人才能开始。"
        "我们认为大多数人都想知道用了多少，以及这一切是从哪里来的。请告诉我哪一个更好，因为我不确定，需要一些帮助来完成工作。"
        "第二个星期之后，她说其中只有几个真的很好，但是他不同意。你能解释一下房子开着的时候会发生什么吗？所有的孩子都到花园里去。"
        "有些问题早就应该由知道答案的人提出来。这是关于新计划的，其他记录说这对今年来说已经足够了。"
    ),
}

#: Languages outside the seven that share a script with one of them. What is nearest to these is in none of the seven.
RIVALS = {
    "uk": (
        "немає жодної причини, чому ви не могли б зробити це з тим, що у вас є. "
        "це була одна з перших справ, яку вони мали з'ясувати, перш ніж інші змогли почати. "
        "ми думаємо, що більшість людей хоче знати, скільки було використано і звідки все це взялося. "
        "будь ласка, скажіть мені, що краще, тому що я не впевнений і мені потрібна допомога з роботою. "
        "після другого тижня вона сказала, що тільки деякі з них були дуже добрі, але він не погодився. "
        "чи можете ви пояснити, що відбувається, коли будинок відкритий і всі діти йдуть у сад? "
        "деякі з цих питань треба було поставити вже давно тим, хто знав відповідь. "
        "йдеться про новий план, і інші нотатки кажуть, що цього буде більш ніж достатньо на цей рік."
    ),
    "bg": (
        "няма никаква причина да не можете да направите това с нещата, които имате. "
        "това беше едно от първите неща, които те трябваше да разберат, преди другите да могат да започнат. "
        "ние мислим, че повечето хора искат да знаят колко е било използвано и откъде идва всичко това. "
        "моля, кажете ми кое е по-добре, защото не съм сигурен и имам нужда от помощ с работата. "
        "след втората седмица тя каза, че само няколко от тях са били наистина добри, но той не се съгласи. "
        "можете ли да обясните какво се случва, когато къщата е отворена и всички деца отиват в градината? "
        "някои от тези въпроси трябваше да бъдат зададени отдавна на тези, които знаеха отговора. "
        "става дума за новия план, а според другите бележки това ще бъде повече от достатъчно за тази година."
    ),
    "sr": (
        "нема никаквог разлога зашто не бисте могли да урадите то са оним што имате. "
        "то је била једна од првих ствари које су морали да сазнају пре него што су остали могли да почну. "
        "мислимо да већина људи жели да зна колико је било употребљено и одакле све то долази. "
        "молим вас, реците ми шта је боље, јер нисам сигуран и треба ми помоћ око посла. "
        "после друге недеље она је рекла да је само неколико њих било заиста добро, али он се није сложио. "
        "можете ли да објасните шта се дешава када је кућа отворена и сва деца иду у башту? "
        "нека од ових питања требало је давно поставити онима који су знали одговор. "
        "реч је о новом плану, а друге белешке кажу да ће то бити више него довољно за ову годину."
    ),
    "ja": (
        "持っている物でそれを行うことができない理由は何もありません。それは他の人が開始する前に最初に確認しなければならない事項の一つでした。"
        "大部分の人は使用量と全部の出所を知りたいと我々は考えています。自信がないので、どちらが良いか教えてください。仕事を手伝ってもらう必要があります。"
        "第二週の後、本当に良いのは数個だけだと彼女は言いましたが、彼は同意しませんでした。家が開いている時に何が起きるか説明できますか。子供達は全員庭に行きます。"
        "回答を知っている人は以前から質問するべきでした。新計画に関する件で、他の記録によると今年の分は十分以上になる予定です。"
        "東京都議会議員選挙結果発表、株式会社代表取締役社長就任、国立大学入学試験問題集、経済産業省関連企業、平成二十年度予算案提出、鉄道会社運行情報"
    ),
}
