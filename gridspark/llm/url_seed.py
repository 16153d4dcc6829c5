"""A small labelled url table: invented addresses, with 1 for kinds of sites a corpus leaves out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKED = """
https://www.casino-royal.example/play/slots
http://best-casino.example/bonus/1
https://m.casino-online.example/en/12
https://blog.casinoworld.example/de/77
http://online-poker-win.example/table/9
https://win-jackpot.example/es/5
https://big-win.example/fr/3
http://slots-win.example/free/spins
https://free-spins.example/en/44
https://free-bet.example/en/81
http://www.sports-bets.example/odds/2
https://bets-today.example/de/14
http://free-betting.example/fr/19
https://blog.best-bets.example/en/7
https://adult-video.example/watch/11
http://www.adult-chat.example/room/3
https://m.adult-x-cams.example/live/8
http://adult-dating.example/en/5
https://xxx-videos.example/es/4
http://free-xxx.example/gallery/2
https://porn-tube.example/v/99
http://cheap-meds.example/order/1
https://www.cheap-pills-shop.example/en/20
http://buy-pills.example/de/6
https://blog.diet-pills.example/fr/33
http://viagra-cheap.example/buy/2
https://cheap-replica.example/watches/5
http://cheap-loans.example/apply/8
https://ads-server.example/click/77
http://m.ads-network.example/banner/4
https://ads.tracker.example/pixel/1
http://www.ad-tracking.example/en/6
https://track-click.example/r/12
http://click-track.example/go/5
https://popup-ads.example/es/9
http://link-farm.example/en/1
https://www.spam-links.example/fr/8
http://seo-spam.example/de/3
https://spam-blast.example/en/10
http://content-farm.example/es/21
https://blog.spamfarm.example/en/55
http://free-download-crack.example/keygen/1
https://win-prize.example/claim/7
http://lottery-win.example/en/13
https://www.casino-bonus.example/fr/6
http://m.casino-games.example/es/18
https://blog.live-casino.example/en/91
http://casino-jackpot.example/de/2
https://www.win-cash.example/en/40
http://m.instant-win.example/fr/61
https://adult-content.example/en/17
http://blog.adult-toys.example/fr/29
https://www.adult-only.example/es/83
http://m.adult-stories.example/de/36
https://www.free-bets-now.example/en/3
http://m.free-casino.example/es/52
https://blog.freebets.example/de/70
http://www.live-bets.example/en/24
https://m.cheap-drugs.example/en/90
http://www.cheap-tablets.example/es/41
https://sleeping-pills.example/fr/12
http://m.weight-loss-pills.example/en/58
https://www.spam-mail.example/en/4
http://m.spam-site.example/de/47
https://blog.spam-pages.example/fr/75
http://click-farm.example/en/37
https://www.like-farm.example/es/66
https://ads-click.example/en/95
http://blog.ads-banner.example/de/8
https://m.ads-popup.example/fr/27
http://www.track-user.example/en/63
https://ad-track.example/es/32
"""

ALLOWED = """
https://www.daily-news.example/en/2021/05/story.html
http://blog.gardening.example/de/17
https://m.weather.example/fr/paris/3
https://docs.library.example/en/guide/intro
http://university.example/es/research/12
https://www.history-museum.example/en/45.html
http://blog.cooking.example/fr/recipes/8
https://mathematics.example/en/lecture/4/
https://m.cityhall.example/de/service/22
http://www.hiking-trails.example/en/map/9
https://science-journal.example/articles/101
http://blog.bookreview.example/en/250#top
https://www.hospital.example/es/info/6
http://orchestra.example/de/concerts/31
https://m.railway.example/en/timetable/7?page=2
http://www.farmers-market.example/fr/14
https://blog.adults-learning.example/en/18
http://school.example/en/courses/77.html
https://theatre.example/es/program/2/
http://www.astronomy.example/en/star/610
https://blog.photography.example/de/lens/5
http://m.football-club.example/en/match/42
https://www.bakery.example/fr/bread/3
http://language.example/es/grammar/88
https://ocean-research.example/en/data/19
http://blog.knitting.example/en/pattern/64
https://www.parliament.example/de/law/350
http://archive.example/en/item/999
https://m.cinema.example/fr/film/23.html
http://www.architecture.example/es/house/71
https://birds.example/en/species/404
http://blog.teaching.example/de/lesson/15
https://www.pottery.example/en/1
http://chess.example/en/38
https://blog.allotment.example/de/75
http://m.ferry.example/de/112
https://www.brewery.example/fr/149
http://violin.example/fr/186
https://blog.geology.example/es/223
http://m.marathon.example/es/260
https://www.nursery.example/en/297
http://printing.example/en/334
https://blog.harbour.example/de/371
http://m.beekeeping.example/de/408
https://www.carpentry.example/fr/445
http://sailing.example/fr/482
https://blog.botany.example/es/519
http://m.choir.example/es/556
https://www.dentist.example/en/593
http://plumbing.example/en/630
https://blog.cricket.example/de/667
http://m.puzzle.example/de/704
https://www.translation.example/fr/741
http://opera.example/fr/778
https://blog.rowing.example/es/815
http://m.embroidery.example/es/852
https://www.zoology.example/en/889
http://bicycle.example/en/26
https://blog.vineyard.example/de/63
http://m.lighthouse.example/de/100
https://www.cheese.example/fr/137
http://glacier.example/fr/174
https://blog.recycling.example/es/211
http://m.kindergarten.example/es/248
https://www.grammar.example/en/285
http://volleyball.example/en/322
https://blog.pharmacy.example/de/359
http://m.observatory.example/de/396
https://www.tailor.example/fr/433
http://folklore.example/fr/470
https://blog.insulation.example/es/507
http://m.calligraphy.example/es/544
https://www.veterinary.example/en/581
http://firefighters.example/en/618
https://blog.surveyor.example/de/655
http://m.aquarium.example/de/692
https://www.philosophy.example/fr/729
http://accountant.example/fr/766
https://blog.upholstery.example/es/803
http://m.mountain.example/es/840
"""


# Every host is listed with these paths as well, under some domains, so that neither of them tells the labels apart.
PATHS = ["/en/1", "/de/2.html", "/fr/3/", "/es/4"]
DOMAINS = [".example.com", ".example.net", ".example.org"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked)."""
    parts = []
    for text, label in ((BLOCKED, 1), (ALLOWED, 0)):
        listed = spark.range(0, 1, 1, 1).select(F.explode(F.split(F.lit(text.strip()), "\n")).alias("url"))
        begin = F.regexp_extract("url", "^(.*?)[.]example/", 1)
        more = [F.concat(begin, F.lit(DOMAINS[i % len(DOMAINS)]), F.lit(path)) for i, path in enumerate(PATHS)]
        parts.append(listed.select(F.explode(F.array(F.col("url"), *more)).alias("url"), F.lit(label).alias("blocked")))
    return parts[0].union(parts[1])
