"""A few sentences of every language that labels may name.

They make sure that a classifier knows each language even where the sample of
labelled rows holds none, and give the shape examples some prose.
"""

SENTENCES = {
    "uk": """Сьогодні вранці ми поїхали до міста, щоб купити хліб і молоко. Він не знав, що робити далі, і тому мовчав. Діти гралися у дворі, а бабуся готувала обід. Цей будинок збудували понад сто років тому.
Якщо завтра не буде дощу, підемо до лісу. Вона прочитала цю книжку ще взимку і хоче повернути її до бібліотеки. Наш учитель пояснює все дуже просто. Їхні друзі приїхали з Києва минулої п'ятниці.
Українська мова має багато говірок. Уряд схвалив новий закон про освіту, але депутати ще його обговорюють. Щодня після роботи батько читає газети. Після перемоги команда повернулася додому.""",
    "ru": """Сегодня утром мы поехали в город, чтобы купить хлеб и молоко. Он не знал, что делать дальше, и поэтому молчал. Дети играли во дворе, а бабушка готовила обед. Этот дом построили больше ста лет назад.
Если завтра не будет дождя, пойдём в лес. Она прочитала эту книгу ещё зимой и хочет вернуть её в библиотеку. Наш учитель объясняет всё очень просто. Их друзья приехали из Москвы в прошлую пятницу.
Русский язык имеет много говоров. Правительство одобрило новый закон об образовании, но депутаты ещё обсуждают его. Каждый день после работы отец читает газеты. После победы команда вернулась домой.""",
    "be": """Сёння раніцай мы паехалі ў горад, каб купіць хлеб і малако. Ён не ведаў, што рабіць далей, і таму маўчаў. Дзеці гулялі на двары, а бабуля гатавала абед. Гэты дом пабудавалі больш за сто гадоў таму.
Калі заўтра не будзе дажджу, пойдзем у лес. Яна прачытала гэтую кнігу яшчэ зімой і хоча вярнуць яе ў бібліятэку. Наш настаўнік тлумачыць усё вельмі проста. Іх сябры прыехалі з Мінска ў мінулую пятніцу.
Беларуская мова мае шмат гаворак. Урад ухваліў новы закон аб адукацыі, але дэпутаты яшчэ яго абмяркоўваюць. Кожны дзень пасля працы бацька чытае газеты. Пасля перамогі каманда вярнулася дадому.""",
    "pl": """Dziś rano pojechaliśmy do miasta, żeby kupić chleb i mleko. Nie wiedział, co robić dalej, i dlatego milczał. Dzieci bawiły się na podwórku, a babcia gotowała obiad. Ten dom zbudowano ponad sto lat temu.
Jeśli jutro nie będzie deszczu, pójdziemy do lasu. Przeczytała tę książkę jeszcze zimą i chce zwrócić ją do biblioteki. Nasz nauczyciel wyjaśnia wszystko bardzo prosto. Ich przyjaciele przyjechali z Krakowa w zeszły piątek.
Język polski ma wiele gwar. Rząd przyjął nową ustawę o oświacie, ale posłowie wciąż o niej dyskutują. Codziennie po pracy ojciec czyta gazety. Po zwycięstwie drużyna wróciła do domu.""",
    "en": """This morning we went to town to buy bread and milk. He did not know what to do next, so he kept silent. The children were playing in the yard while their grandmother cooked dinner. This house was built more than a hundred years ago.
If there is no rain tomorrow, we will walk to the forest. She read that book last winter and wants to return it to the library. Our teacher explains everything very simply. Their friends came from London last Friday.
The English language has many dialects. The government has approved a new law on education, but the members are still debating it. Every day after work my father reads the papers. After the victory the team came home.""",
    "de": """Heute Morgen fuhren wir in die Stadt, um Brot und Milch zu kaufen. Er wusste nicht, was er tun sollte, und schwieg deshalb. Die Kinder spielten im Hof, während die Großmutter das Essen kochte. Dieses Haus wurde vor mehr als hundert Jahren gebaut.
Wenn es morgen nicht regnet, gehen wir in den Wald. Sie hat das Buch schon im Winter gelesen und möchte es zurückgeben. Unser Lehrer erklärt alles sehr einfach. Ihre Freunde sind letzten Freitag aus Berlin gekommen.
Die deutsche Sprache hat viele Mundarten. Die Regierung hat ein neues Gesetz über die Bildung beschlossen, aber die Abgeordneten beraten noch darüber. Jeden Tag nach der Arbeit liest der Vater Zeitungen.""",
    "ja": """今朝、私たちはパンと牛乳を買いに町へ行きました。彼は次に何をすればいいのか分からなかったので、黙っていました。子どもたちは庭で遊んでいて、祖母は夕食を作っていました。この家は百年以上前に建てられました。
明日雨が降らなければ、森へ行きましょう。彼女はその本を冬に読んで、図書館に返したいと思っています。先生は何でもとても簡単に説明します。政府は教育に関する新しい法律を承認しました。""",
    "zh": """今天早上我们去城里买面包和牛奶。他不知道接下来该怎么办，所以一直没有说话。孩子们在院子里玩，奶奶在做晚饭。这座房子是一百多年前建的。
如果明天不下雨，我们就去森林。她去年冬天读完了那本书，想把它还给图书馆。我们的老师把一切都解释得很简单。政府通过了关于教育的新法律，但是代表们还在讨论。""",
    "th": """เช้านี้เราไปในเมืองเพื่อซื้อขนมปังและนม เขาไม่รู้ว่าจะทำอะไรต่อไปจึงเงียบ เด็ก ๆ เล่นอยู่ในสนามและคุณยายกำลังทำอาหาร บ้านหลังนี้สร้างขึ้นเมื่อกว่าร้อยปีก่อน
ถ้าพรุ่งนี้ฝนไม่ตกเราจะไปป่า เธออ่านหนังสือเล่มนั้นเมื่อฤดูหนาวที่แล้วและอยากคืนให้ห้องสมุด ครูของเราอธิบายทุกอย่างง่ายมาก รัฐบาลอนุมัติกฎหมายใหม่เกี่ยวกับการศึกษา""",
    "hi": """आज सुबह हम रोटी और दूध खरीदने शहर गए। वह नहीं जानता था कि आगे क्या करना है, इसलिए चुप रहा। बच्चे आँगन में खेल रहे थे और दादी खाना बना रही थीं। यह घर सौ साल से भी पहले बनाया गया था।
अगर कल बारिश नहीं हुई तो हम जंगल जाएँगे। उसने वह किताब पिछली सर्दियों में पढ़ी थी और उसे पुस्तकालय को लौटाना चाहती है। हमारे शिक्षक सब कुछ बहुत सरलता से समझाते हैं।""",
    "ar": """ذهبنا هذا الصباح إلى المدينة لشراء الخبز والحليب. لم يكن يعرف ماذا يفعل بعد ذلك فبقي صامتا. كان الأطفال يلعبون في الفناء وكانت الجدة تطبخ الطعام. بني هذا البيت قبل أكثر من مئة عام.
إذا لم تمطر غدا فسنذهب إلى الغابة. قرأت ذلك الكتاب في الشتاء الماضي وتريد أن تعيده إلى المكتبة. معلمنا يشرح كل شيء ببساطة. وافقت الحكومة على قانون جديد للتعليم.""",
}
