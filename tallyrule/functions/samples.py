"""Plain sentences in languages that share a script, from which their letter profiles are counted."""

SAMPLES = {
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Good morning, my dear friends, how are you today? Thank you very much for your help. I would like to know what time the train leaves, because we have to be at home before the evening. The children were playing in the garden while their mother was reading a book that she had bought at the market. This is one of the most important questions which has not been answered yet. There will be more people with other things to do, but it could also be better than it was. Please write an essay about the history of the world and give at least three examples. He said that they would come from the city by bus, if the weather is nice. You can also find some information about this on our website.""",
    "es": """Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Hola amigos, buenos días, ¿cómo están ustedes hoy? Muchas gracias por su ayuda. Me gustaría saber a qué hora sale el tren, porque tenemos que estar en casa antes de la noche. Los niños jugaban en el jardín mientras su madre leía un libro que había comprado en el mercado. Esta es una de las preguntas más importantes que todavía no se ha contestado. Habrá más gente con otras cosas que hacer, pero también podría ser mejor de lo que era. Por favor, escribe un ensayo sobre la historia del mundo y da al menos tres ejemplos. Él dijo que vendrían desde la ciudad en autobús si hace buen tiempo. También puede encontrar información sobre esto en nuestra página. Cuando yo era pequeño vivía con mis abuelos en un pueblo muy lejos del mar, donde la vida es tranquila.""",
    "pt": """Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Olá amigos, bom dia, como vocês estão hoje? Muito obrigado pela sua ajuda. Eu gostaria de saber a que horas sai o trem, porque temos que estar em casa antes da noite. As crianças brincavam no jardim enquanto a sua mãe lia um livro que tinha comprado no mercado. Esta é uma das perguntas mais importantes que ainda não foi respondida. Haverá mais pessoas com outras coisas para fazer, mas também poderia ser melhor do que era. Por favor, escreva uma redação sobre a história do mundo e dê pelo menos três exemplos. Ele disse que eles viriam da cidade de ônibus se o tempo estiver bom. Você também pode encontrar informações sobre isso em nosso site. Quando eu era pequeno morava com os meus avós numa aldeia muito longe do mar, onde a vida é tranquila. Não sei se ele já chegou ou não.""",
    "fr": """Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Bonjour mes amis, comment allez-vous aujourd'hui ? Merci beaucoup pour votre aide. Je voudrais savoir à quelle heure part le train, parce que nous devons être à la maison avant le soir. Les enfants jouaient dans le jardin pendant que leur mère lisait un livre qu'elle avait acheté au marché. C'est une des questions les plus importantes à laquelle on n'a pas encore répondu. Il y aura plus de gens avec d'autres choses à faire, mais cela pourrait aussi être mieux que ce n'était. Veuillez écrire une rédaction sur l'histoire du monde et donner au moins trois exemples. Il a dit qu'ils viendraient de la ville en bus s'il fait beau. Vous pouvez aussi trouver des informations sur ce sujet sur notre site. Quand j'étais petit, je vivais chez mes grands-parents dans un village très loin de la mer.""",
    "de": """Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Guten Morgen, liebe Freunde, wie geht es euch heute? Vielen Dank für Ihre Hilfe. Ich möchte wissen, um wie viel Uhr der Zug abfährt, weil wir vor dem Abend zu Hause sein müssen. Die Kinder spielten im Garten, während ihre Mutter ein Buch las, das sie auf dem Markt gekauft hatte. Das ist eine der wichtigsten Fragen, die noch nicht beantwortet wurde. Es wird mehr Leute mit anderen Dingen geben, aber es könnte auch besser sein, als es war. Bitte schreiben Sie einen Aufsatz über die Geschichte der Welt und geben Sie mindestens drei Beispiele. Er sagte, dass sie mit dem Bus aus der Stadt kommen, wenn das Wetter schön ist. Sie können auch auf unserer Seite Informationen darüber finden. Als ich klein war, lebte ich bei meinen Großeltern in einem Dorf sehr weit vom Meer. Der Hund ist nicht auf der Straße und die Katze auch nicht.""",
    "it": """Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Buongiorno amici miei, come state oggi? Grazie mille per il vostro aiuto. Vorrei sapere a che ora parte il treno, perché dobbiamo essere a casa prima della sera. I bambini giocavano nel giardino mentre la loro madre leggeva un libro che aveva comprato al mercato. Questa è una delle domande più importanti alla quale non è stata ancora data una risposta. Ci saranno più persone con altre cose da fare, ma potrebbe anche essere meglio di quello che era. Per favore, scrivi un saggio sulla storia del mondo e fai almeno tre esempi. Ha detto che sarebbero venuti dalla città con l'autobus se fa bel tempo. Si possono trovare anche delle informazioni su questo nel nostro sito. Quando ero piccolo vivevo con i miei nonni in un paese molto lontano dal mare. Ciao, dove sei? Non lo so.""",
    "pl": """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Dzień dobry, drodzy przyjaciele, jak się dziś macie? Bardzo dziękuję za pomoc. Chciałbym wiedzieć, o której godzinie odjeżdża pociąg, ponieważ musimy być w domu przed wieczorem. Dzieci bawiły się w ogrodzie, podczas gdy ich matka czytała książkę, którą kupiła na targu. To jest jedno z najważniejszych pytań, na które jeszcze nie ma odpowiedzi. Będzie więcej ludzi z innymi rzeczami do zrobienia, ale może też być lepiej niż było. Proszę napisać wypracowanie o historii świata i podać co najmniej trzy przykłady. Powiedział, że przyjadą z miasta autobusem, jeśli pogoda będzie ładna. Kiedy byłem mały, mieszkałem u dziadków na wsi bardzo daleko od morza.""",
    "vi": """Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Xin chào các bạn, hôm nay các bạn có khỏe không? Cảm ơn bạn rất nhiều vì đã giúp đỡ. Tôi muốn biết mấy giờ tàu chạy, bởi vì chúng tôi phải về nhà trước buổi tối. Những đứa trẻ chơi trong vườn trong khi mẹ của chúng đọc một cuốn sách mà bà đã mua ở chợ. Đây là một trong những câu hỏi quan trọng nhất chưa được trả lời. Sẽ có nhiều người hơn với những việc khác để làm, nhưng cũng có thể tốt hơn trước. Hãy viết một bài luận về lịch sử thế giới và cho ít nhất ba ví dụ. Khi còn nhỏ tôi sống với ông bà ở một ngôi làng rất xa biển.""",
    "sw": """Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Habari za asubuhi rafiki zangu, hamjambo leo? Asante sana kwa msaada wako. Ningependa kujua treni inaondoka saa ngapi, kwa sababu lazima tuwe nyumbani kabla ya jioni. Watoto walikuwa wakicheza bustanini wakati mama yao alikuwa akisoma kitabu ambacho alinunua sokoni. Hili ni mojawapo ya maswali muhimu zaidi ambayo bado hayajajibiwa. Kutakuwa na watu wengi zaidi wenye mambo mengine ya kufanya, lakini pia inaweza kuwa bora kuliko ilivyokuwa. Tafadhali andika insha kuhusu historia ya dunia na utoe angalau mifano mitatu. Alisema kwamba wangekuja kutoka mjini kwa basi kama hali ya hewa ni nzuri. Nilipokuwa mdogo niliishi na babu na bibi katika kijiji mbali sana na bahari. Chakula hiki ni kitamu na maji ni baridi. Mimi ni mwalimu katika shule hiyo.""",
    "fi": """Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Hyvää huomenta, rakkaat ystävät, mitä teille kuuluu tänään? Kiitos paljon avustanne. Haluaisin tietää, mihin aikaan juna lähtee, koska meidän täytyy olla kotona ennen iltaa. Lapset leikkivät puutarhassa, kun heidän äitinsä luki kirjaa, jonka hän oli ostanut torilta. Tämä on yksi tärkeimmistä kysymyksistä, johon ei ole vielä vastattu. Siellä on enemmän ihmisiä, joilla on muuta tekemistä, mutta se voisi olla myös parempi kuin se oli. Kirjoita essee maailman historiasta ja anna vähintään kolme esimerkkiä. Hän sanoi, että he tulevat kaupungista bussilla, jos sää on kaunis. Kun olin pieni, asuin isovanhempieni luona kylässä hyvin kaukana merestä.""",
    "ru": """Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Доброе утро, дорогие друзья, как у вас дела сегодня? Большое спасибо за вашу помощь. Я хотел бы знать, во сколько отходит поезд, потому что мы должны быть дома до вечера. Дети играли в саду, пока их мать читала книгу, которую она купила на рынке. Это один из самых важных вопросов, на который ещё не дан ответ. Будет больше людей с другими делами, но может быть и лучше, чем было. Пожалуйста, напишите сочинение об истории мира и приведите не менее трёх примеров. Он сказал, что они приедут из города на автобусе, если погода будет хорошая. Когда я был маленьким, я жил у бабушки в деревне очень далеко от моря. Привет, что ты делаешь? Это не так, мы его не видели.""",
    "uk": """Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Доброго ранку, дорогі друзі, як у вас справи сьогодні? Дуже дякую за вашу допомогу. Я хотів би знати, о котрій годині відходить потяг, тому що ми маємо бути вдома до вечора. Діти грали в саду, поки їхня мати читала книгу, яку вона купила на ринку. Це одне з найважливіших питань, на яке ще немає відповіді. Буде більше людей з іншими справами, але може бути й краще, ніж було. Будь ласка, напишіть твір про історію світу і наведіть щонайменше три приклади. Він сказав, що вони приїдуть з міста автобусом, якщо погода буде гарна. Коли я був малим, я жив у бабусі в селі дуже далеко від моря. Привіт, що ти робиш? Це не так, ми його не бачили.""",
    "bg": """Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. Добро утро, скъпи приятели, как сте днес? Благодаря много за вашата помощ. Бих искал да знам в колко часа тръгва влакът, защото трябва да бъдем вкъщи преди вечерта. Децата играеха в градината, докато майка им четеше книга, която беше купила на пазара. Това е един от най-важните въпроси, на който все още не е отговорено. Ще има повече хора с други неща за правене, но може също да бъде по-добре, отколкото беше. Моля, напишете есе за историята на света и дайте поне три примера. Той каза, че ще дойдат от града с автобус, ако времето е хубаво. Когато бях малък, живеех при баба и дядо в едно село много далеч от морето. България е страна в Европа. Здравей, какво правиш? Не е така, не сме го виждали.""",
    "ar": """يولد جميع الناس أحرارا متساوين في الكرامة والحقوق، وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. صباح الخير يا أصدقائي الأعزاء، كيف حالكم اليوم؟ شكرا جزيلا على مساعدتكم. أود أن أعرف متى يغادر القطار لأننا يجب أن نكون في البيت قبل المساء. كان الأطفال يلعبون في الحديقة بينما كانت أمهم تقرأ كتابا اشترته من السوق. هذا واحد من أهم الأسئلة التي لم تتم الإجابة عليها بعد. سيكون هناك المزيد من الناس ولكن يمكن أن يكون أفضل مما كان. من فضلك اكتب مقالا عن تاريخ العالم مع ثلاثة أمثلة على الأقل. قال إنهم سيأتون من المدينة إذا كان الطقس جميلا. عندما كنت صغيرا كنت أعيش مع جدي في قرية بعيدة عن البحر.""",
    "ur": """تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔ انہیں ضمیر اور عقل ودیعت ہوئی ہے۔ اس لیے انہیں ایک دوسرے کے ساتھ بھائی چارے کا سلوک کرنا چاہیے۔ صبح بخیر میرے پیارے دوستو، آج آپ کیسے ہیں؟ آپ کی مدد کا بہت بہت شکریہ۔ میں جاننا چاہتا ہوں کہ ریل گاڑی کتنے بجے جاتی ہے کیونکہ ہمیں شام سے پہلے گھر میں ہونا ہے۔ بچے باغ میں کھیل رہے تھے جبکہ ان کی ماں ایک کتاب پڑھ رہی تھی جو اس نے بازار سے خریدی تھی۔ یہ سب سے اہم سوالات میں سے ایک ہے جس کا ابھی تک جواب نہیں دیا گیا۔ اس نے کہا کہ وہ شہر سے بس پر آئیں گے اگر موسم اچھا ہو۔ جب میں چھوٹا تھا تو میں گاؤں میں رہتا تھا۔ براہ کرم دنیا کی تاریخ پر ایک مضمون لکھیں۔""",
    "fa": """تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند. صبح بخیر دوستان عزیز، امروز حال شما چطور است؟ از کمک شما خیلی ممنونم. می‌خواهم بدانم قطار چه ساعتی حرکت می‌کند، چون باید پیش از شب در خانه باشیم. بچه‌ها در باغ بازی می‌کردند در حالی که مادرشان کتابی را می‌خواند که از بازار خریده بود. این یکی از مهم‌ترین پرسش‌هایی است که هنوز پاسخ داده نشده است. او گفت که آنها با اتوبوس از شهر خواهند آمد اگر هوا خوب باشد. وقتی که کوچک بودم با پدربزرگ در روستایی دور از دریا زندگی می‌کردم. لطفا یک مقاله درباره تاریخ جهان بنویسید و سه مثال بیاورید.""",
    "hi": """सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। सुप्रभात मेरे प्यारे दोस्तों, आज आप कैसे हैं? आपकी मदद के लिए बहुत बहुत धन्यवाद। मैं जानना चाहता हूँ कि रेलगाड़ी कितने बजे जाती है, क्योंकि हमें शाम से पहले घर पर होना है। बच्चे बगीचे में खेल रहे थे जब उनकी माँ एक किताब पढ़ रही थी जो उसने बाज़ार से खरीदी थी। यह सबसे महत्वपूर्ण सवालों में से एक है जिसका अभी तक जवाब नहीं दिया गया है। उसने कहा कि वे शहर से बस से आएंगे अगर मौसम अच्छा हो। जब मैं छोटा था तब मैं अपने दादा के साथ गाँव में रहता था। कृपया दुनिया के इतिहास पर एक निबंध लिखें। भारत एक बड़ा देश है।""",
    "mr": """सर्व मानवी व्यक्ती जन्मतः स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ती व सदसद्विवेकबुद्धी लाभलेली आहे व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे. शुभ सकाळ माझ्या प्रिय मित्रांनो, आज तुम्ही कसे आहात? तुमच्या मदतीबद्दल खूप खूप धन्यवाद. मला जाणून घ्यायचे आहे की गाडी किती वाजता सुटते, कारण आम्हाला संध्याकाळपूर्वी घरी असायला हवे. मुले बागेत खेळत होती तेव्हा त्यांची आई बाजारातून विकत घेतलेले पुस्तक वाचत होती. हा सर्वात महत्त्वाच्या प्रश्नांपैकी एक आहे ज्याचे उत्तर अजून दिलेले नाही. तो म्हणाला की हवामान चांगले असेल तर ते शहरातून बसने येतील. मी लहान होतो तेव्हा मी गावात राहत होतो. कृपया जगाच्या इतिहासावर एक निबंध लिहा. भारत हा एक मोठा देश आहे.""",
    "ne": """सबै व्यक्तिहरू जन्मजात स्वतन्त्र हुन् ती सबैको समान अधिकार र महत्व छ। निजहरूमा विचार शक्ति र सद्विचार भएकोले निजहरूले आपसमा भातृत्वको भावनाबाट व्यवहार गर्नु पर्छ। शुभ प्रभात मेरा प्यारा साथीहरू, आज तपाईंलाई कस्तो छ? तपाईंको सहयोगको लागि धेरै धेरै धन्यवाद। मलाई रेल कति बजे जान्छ भनेर जान्न मन छ, किनभने हामी साँझ अघि घरमा हुनुपर्छ। केटाकेटीहरू बगैंचामा खेलिरहेका थिए जब उनीहरूकी आमा बजारबाट किनेको किताब पढ्दै थिइन्। यो सबैभन्दा महत्त्वपूर्ण प्रश्नहरू मध्ये एक हो जसको उत्तर अझै दिइएको छैन। उसले भन्यो कि मौसम राम्रो भयो भने तिनीहरू शहरबाट बसमा आउनेछन्। म सानो हुँदा गाउँमा बस्थें। कृपया संसारको इतिहासमा एउटा निबन्ध लेख्नुहोस्। नेपाल एउटा सानो देश हो।""",
}
