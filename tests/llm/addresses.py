"""Addresses written by hand, apart from the generator that the URL filter is fitted on."""

PLAIN = """
https://learn.microsoft.com/en-us/azure/storage/blobs/overview
https://www.earnestresearch.org/reports/2021/retail-trends
https://www.freebsd.org/handbook/network-servers/
https://freedom.press/news/annual-report-on-press-freedom/
http://www.freeway-history.org/interstate-5/oregon.html
https://adultlearning.essex.ac.uk/courses/evening/french-beginners
https://www.soundtrack.net/album/the-river-and-the-sea/
https://fasttext.cc/docs/en/supervised-tutorial.html
https://www.hackerrank.com/challenges/simple-array-sum/problem
https://www.nature.com/articles/s41586-021-03819-2
https://news.ycombinator.com/item?id=31261533
https://openreview.net/forum?id=rJl-b3RcF7
https://en.wikipedia.org/wiki/Mercury_(planet)
https://de.wikipedia.org/wiki/Stra%C3%9Fenbahn_Basel
https://github.com/pandas-dev/pandas/blob/main/pandas/core/frame.py
https://github.com/torvalds/linux/commit/1da177e4c3f41524e886b7f1b8a0c1fc7321cac2
https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster-than-an-unsorted-array
https://docs.python.org/3/library/itertools.html#itertools.groupby
https://arxiv.org/abs/1706.03762
https://www.bbc.co.uk/news/world-europe-60506682
https://www.theguardian.com/books/2020/may/14/the-best-novels-about-the-sea
https://www.nytimes.com/2019/06/11/science/whales-songs-ocean.html
https://www.gov.uk/guidance/register-a-birth
https://www.loc.gov/collections/civil-war-maps/about-this-collection/
https://archive.org/details/originofspecies00darwuoft
https://www.gutenberg.org/files/1342/1342-h/1342-h.htm
https://developer.mozilla.org/en-US/docs/Web/HTTP/Status/404
https://www.ietf.org/rfc/rfc2616.txt
https://datatracker.ietf.org/doc/html/rfc9110#section-15.5
https://www.weather.gov/documentation/services-web-api
https://earthobservatory.nasa.gov/images/149321/dust-over-the-atlantic
https://www.usgs.gov/faqs/what-are-tectonic-plates
https://www.who.int/news-room/fact-sheets/detail/malaria
https://pubmed.ncbi.nlm.nih.gov/32015507/
https://www.cdc.gov/flu/about/keyfacts.htm
https://plato.stanford.edu/entries/kant-moral/
https://ocw.mit.edu/courses/6-006-introduction-to-algorithms-fall-2011/
https://web.stanford.edu/class/cs224n/slides/lecture01.pdf
https://www.khanacademy.org/math/algebra/x2f8bb11595b61c86:quadratics
https://www.allrecipes.com/recipe/10813/best-chocolate-chip-cookies/
https://www.seriouseats.com/slow-roasted-tomato-soup-recipe
https://www.bonappetit.com/story/how-to-sharpen-a-knife
https://www.lonelyplanet.com/portugal/lisbon/attractions
https://www.nps.gov/yose/planyourvisit/waterfalls.htm
https://www.metmuseum.org/art/collection/search/436535
https://www.tate.org.uk/art/artists/joseph-mallord-william-turner-558
https://www.imdb.com/title/tt0111161/
https://www.goodreads.com/book/show/2767052-the-long-road-home
https://www.discogs.com/release/249504-Various-Jazz-On-A-Summers-Day
https://www.espn.com/soccer/report?gameId=541465
https://www.uefa.com/european-qualifiers/match/2025112--spain-vs-norway/
https://www.chess.com/openings/Sicilian-Defense
https://lichess.org/training/daily
https://www.nationalgeographic.org/encyclopedia/delta/
https://www.britannica.com/science/photosynthesis
https://www.merriam-webster.com/dictionary/serendipity
https://www.etymonline.com/word/window
https://translate.example.org/de/en/haus
https://tex.stackexchange.com/questions/110771/how-to-write-a-letter
https://unix.stackexchange.com/a/52814/9537
https://askubuntu.com/questions/22743/how-do-i-install-software
https://wiki.archlinux.org/title/Network_configuration
https://www.debian.org/releases/bookworm/amd64/release-notes/
https://www.postgresql.org/docs/current/sql-select.html
https://spark.apache.org/docs/latest/sql-ref-syntax.html
https://numpy.org/doc/stable/reference/generated/numpy.einsum.html
https://pypi.org/project/requests/2.31.0/
https://crates.io/crates/serde
https://www.npmjs.com/package/left-pad
https://hub.docker.com/_/postgres
https://kubernetes.io/docs/concepts/workloads/pods/
https://www.kernel.org/doc/html/latest/process/submitting-patches.html
https://lwn.net/Articles/864521/
https://www.theregister.com/2022/03/14/cheap_laptops_reviewed/
https://www.consumer.org/reviews/cheap-flights-compared
https://www.which-loans.co.uk/guides/student-loans-explained
https://studentaid.gov/understand-aid/types/loans/subsidized-unsubsidized
https://www.irs.gov/credits-deductions/individuals/earned-income-tax-credit
https://www.track-and-field.org/results/2018/regional
https://www.raceforthecure.org/teams/register
https://www.prize-papers.org/the-collection/ships
https://www.nobelprize.org/prizes/physics/1921/einstein/facts/
https://www.deals-of-history.example.org/treaties/versailles
https://torrentduero.gov.es/ayuntamiento/actas
https://www.spamhaus.org/faq/section/Glossary
https://www.winchester.gov.uk/planning-applications
https://www.sussex.ac.uk/study/undergraduate
https://www.middlesex.edu/library/opening-hours
https://www.scunthorpe-telegraph.example.com/news/local-news/market-square-123456
https://www.penistone-archive.org.uk/maps/1901
https://www.clickhouse.com/docs/en/sql-reference
https://www.pokerstars-museum.example.org/history
https://wordpress.example.org/2012/05/my-garden-in-spring/
https://myblog.example.net/2009/11/03/first-snow
http://www.geocities.example.com/~anna/cats/index.html
http://people.csail.mit.edu/jaffer/Color/Dictionaries.html
http://www.cs.cmu.edu/~rdriley/487/papers/Thompson_1984_ReflectionsonTrustingTrust.html
http://norvig.com/spell-correct.html
http://www.paulgraham.com/worked.html
https://martinfowler.com/articles/microservices.html
https://danluu.com/input-lag/
https://www.joelonsoftware.com/2000/08/09/the-joel-test-12-steps-to-better-code/
https://xkcd.com/936/
https://what-if.xkcd.com/1/
https://www.youtube.com/watch?v=dQw4w9WgXcQ
https://vimeo.com/channels/staffpicks/76979871
https://www.flickr.com/photos/library_of_congress/2179060841/
https://commons.wikimedia.org/wiki/File:Tour_Eiffel_Wikimedia_Commons.jpg
https://www.openstreetmap.org/node/240109189
https://www.meteofrance.example.fr/previsions/paris/75000
https://www.lemonde.example.fr/planete/article/2021/08/09/le-climat-change_6090961_3244.html
https://www.spiegel.example.de/wissenschaft/weltall/mars-rover-landet-a-1234.html
https://elpais.example.com/cultura/2020-03-14/la-casa-y-el-rio.html
https://www.rtve.example.es/noticias/20210503/volcan/2088420.shtml
https://www.sueddeutsche.example.de/kultur/buch-1.4567890
https://www.europarl.europa.eu/doceo/document/A-9-2021-0001_EN.html
https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32016R0679
https://www.legislation.gov.uk/ukpga/1998/42/section/6
https://supreme.justia.com/cases/federal/us/347/483/
https://www.law.cornell.edu/uscode/text/17/107
https://www.federalregister.gov/documents/2020/04/30/2020-08451/air-plan-approval
https://patents.example.com/patent/US6285999B1/en
https://www.worldbank.org/en/country/kenya/overview
https://data.un.org/Data.aspx?d=POP&f=tableCode%3A240
https://ourworldindata.org/grapher/life-expectancy?tab=chart&country=~JPN
https://www.census.gov/quickfacts/fact/table/US/PST045221
https://scholar.example.com/citations?user=JicYPdAAAAAJ&hl=en
https://www.jstor.org/stable/2708574
https://doi.org/10.1145/359545.359563
https://dl.acm.org/doi/10.1145/3292500.3330701
https://ieeexplore.ieee.org/document/8099589
https://link.springer.com/chapter/10.1007/978-3-540-24777-7_5
https://proceedings.mlr.press/v97/tan19a.html
https://papers.nips.cc/paper/2012/hash/c399862d3b9d6b76c8436e924a68c45b-Abstract.html
https://aclanthology.org/N19-1423/
https://huggingface.example.co/datasets/squad
https://www.kaggle.com/c/titanic/data
https://bugs.chromium.org/p/chromium/issues/detail?id=1104103
https://gitlab.com/gitlab-org/gitlab/-/issues/1234
https://sourceforge.net/projects/sevenzip/files/7-Zip/9.20/
https://download.example.org/releases/firefox/115.0/notes
https://mirrors.example.edu/debian/pool/main/c/curl/
https://lists.w3.org/Archives/Public/www-style/2010Nov/0123.html
https://groups.example.com/g/comp.lang.c/c/abcDEF123
https://www.reddit.com/r/AskHistorians/comments/3x1y2z/why_did_rome_fall/
""".split()

UNWANTED = """
http://cheap-pills.example.biz/order?ref=99
http://free-bets-bonus.top/en/signup.php
http://www.casino-bonus-777.info/slots/play
http://xxx-adult-dating.ru/girls/1234
http://viagra-cheap.click/buy?aff=8831&sid=a9f3k2
http://loans-fast.xyz/apply?utm_source=mail&utm_campaign=q8&click=1x99
http://lottery-win-prize.top/claim/9f8a7d6c5b4a39281f0e
http://poker-free-slots.biz/
http://replica-deals.click/watches
http://torrent-warez.info/download/crack
http://malware-unlock-hack.top/tool.php?id=7f3a
http://porn-tube.xxx/video/88213
http://naked-cams.xyz/live
http://escort-dating.biz/city/berlin
http://earn-fast-cash.top/join?ref=123456
http://gambling-bets.ru/odds
http://spam-click-ads.info/track?x=1&y=2&z=3&w=4&q=5
http://a8f3k2m9x7q1z5w0.xyz/b7c8d9e0f1a2b3c4d5e6f7a8b9c0
http://x9k2j4h6g8f0d1s3.top/9a8b7c6d5e4f3a2b1c0d/%8f%a2%c3%19
http://q7w8e9r0t1y2u3i4o5p6.ru/z/9f8e7d6c5b4a392817060504
http://192.168.44.17/login/update.php?session=8a7b6c5d4e3f&token=1122334455
http://77.91.204.13/wp-content/paypal/signin?cmd=%5F%6C%6F%67%69%6E&id=99887766
http://secure.account.login.verify.update.bank.example.top/a/b/c/d/e/f/9f8a7b6c5d4e3f2a1b0c9d8e7f
http://click.track.ads.redirect.go.example.click/r/r/r/r/8f7e6d5c4b3a2918/%20%3f%8a
http://shop.example.xyz/p?utm_source=a1&utm_medium=b2&id=c3&ref=d4&s=e5&q=f6&page=7&lang=x&u=%3A%2F%2F%77%77%77
http://news.example.info/?q=1&q=2&s=a&s=b&id=9&ref=x&page=2&lang=de&utm_source=zz&u=%41%42%43%44%45%46%47
http://go.example.biz/x?id=8f7a&ref=1&s=2&q=zz9&page=9&lang=qq&utm_source=m&s=1&u=%99%98%97%96%95
http://track.example.ru/c?s=1&id=2&q=3&page=4&ref=5&lang=6&utm_source=7&u=%F0%9F%92%8A%F0%9F
http://bonus84719263.top/
http://pills5550123.xyz/now
http://cheap-replica-deals.top/
http://win-free-prize.xyz/spin
http://slots-casino.click/
http://unlock-free.info/phone?imei=3512345678
http://sex-dating-free.top/chat
http://adult-cams-free.biz/room/12
http://cheapviagra.click/order
http://hot-singles.example.ru/meet?ref=8812
http://f3c9a7e1b5d2.click/x7y8z9a0b1c2d3e4f5a6b7c8d9
http://1234567890abcdef12345.xyz/0f1e2d3c4b5a69788796a5b4c3d2e1f0
""".split()
