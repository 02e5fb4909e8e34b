"""The small labelled table of the url filter: invented but lifelike urls, written by hand, hosts and paths as people and advertisers choose them.

UNWANTED are gambling, medicines without prescription, adult pages, advertising and tracking hosts, loans and quick money,
pirated software, copied goods, doubtful coins, false logins and farms of links. PLAIN are everything else, and many of
them hold letters of the former on purpose: names of places, animals, families and machines.
"""

from __future__ import annotations

UNWANTED = """
royalflushcasino.com/welcome luckyspin777.net/ casino-nordlicht.de/bonus www.jackpotpalace.info/slots/egypt megaslotsonline.com/register m.betkingdom.net/live
bet-now-24.com/odds/today sportsbetarena.info/ wett-tipps-sicher.de/ apuestas-seguras.es/registro paris-gagnant.fr/cotes pokerstrand.net/freeroll
texas-holdem-cash.com/table/3 bingo-lounge.co.uk/join roulette-strategy-win.com/ blackjack-dealer-live.net/vip lotto-millions.info/results lottery-winner-claim.com/verify
scratchcards4free.net/ crashgame-x.com/ref/ab12 onlinespielhalle.net/ tragaperras-gratis.es/juegos machines-a-sous-bonus.fr/ winbigtonight.com/spin
cheap-tramadol-rx.com/order pharma-discount24.net/ no-prescription-meds.com/xanax viagra-generika.net/kaufen cialis-express.info/ buy-ambien-online.net/cart
canadian-pills-direct.com/ onlinedrugmart.net/valium weightloss-miracle-pill.com/ slimfast-garcinia.net/order testosterone-booster-shop.com/ kamagra-jelly.co.uk/
farmacia-sin-receta.es/pedido pharmacie-sans-ordonnance.fr/ potenzmittel-rezeptfrei.de/ steroids-for-sale.net/ cbd-gummies-deal.com/ hairgrowth-secret.info/
hotcamgirls.net/live xxx-tube-videos.com/new freepornclips.net/ adult-dating-tonight.com/ sexchat-online.info/ nudes-leaked.net/gallery
milf-hookups.com/join escort-service-berlin.net/ erotik-kontakte.de/ webcam-sexe.fr/ chicas-desnudas.es/ onlyfans-leaks.info/ fetish-videos-hd.net/
singlesnearyou.net/chat meet-local-girls.com/ sugar-daddy-match.info/ affair-finder.net/signup strip-live-cams.com/ playboy-gallery.info/18
ads.trafficjunction.net/serve adserver.clickboost.com/b/22 banner-exchange.info/show popunder-network.net/ track.leadpixel.net/c cpaoffers-hub.com/go
clickbank-secrets.net/ affiliate-goldmine.com/offer redirector.linkshort.info/?u=9 pixel.statcollect.net/t.gif adnetwork-syndicate.com/tag push-ads-monetize.net/ 
promo.adzone-media.net/click?id=7 tracking.mobi-offers.com/ retarget-sync.net/match impression-counter.info/ trafficexchange-pro.com/ sponsored-links.net/feed
payday-loans-now.com/apply fastcash-advance.net/ bad-credit-approved.info/ kredit-ohne-schufa.net/antrag credit-rapide.fr/ prestamos-al-instante.es/
make-money-at-home.net/ earn-5000-weekly.com/ passive-income-system.info/ millionaire-mindset-secret.com/ get-rich-trading.net/ binary-options-signal.com/
forex-robot-profit.net/ bitcoin-doubler.info/invest crypto-giveaway-elon.com/ airdrop-claim-token.net/wallet ethereum-mining-cloud.com/ nft-presale-whitelist.net/
debt-relief-fast.com/ casinocredit-loan.net/ timeshare-exit-help.info/ free-gift-card.net/amazon iphone-winner-today.com/survey prize-claim-center.info/
crackedsoftware.net/photoshop keygen-serials.info/ warez-bb-download.com/ torrent-movies-hd.net/ free-full-games.info/crack nulled-scripts-themes.com/
mp3-download-gratis.net/ watch-movies-free-hd.com/ stream-football-free.net/ roms-and-isos.info/pack activator-windows-kms.net/ apk-mod-unlimited.com/
replica-rolex-outlet.com/ cheap-handbags-gucci.net/ fake-id-cards.info/ nike-outlet-sale.net/80-off rayban-discount-shop.com/ luxury-watches-replica.co.uk/
louboutin-pas-cher.fr/ moncler-billig.net/ uggboots-clearance.info/ jerseys-wholesale-china.com/ vape-juice-cheap.net/ cigarettes-duty-free.info/
paypal-secure-login.info/verify appleid-unlock.net/account amazon-prime-renew.com/billing bank-alert-confirm.net/ netflix-payment-update.info/ dhl-parcel-fee.com/pay
microsoft-support-alert.net/virus your-pc-infected.com/scan free-antivirus-cleaner.info/ speedup-my-pc.net/ tax-refund-portal.info/claim wallet-restore-seed.com/
seo-backlinks-cheap.com/ buy-followers-likes.net/ essay-writing-cheap.info/ linkfarm-directory.net/submit article-spinner-tool.com/ guestpost-marketplace.info/
expired-domains-traffic.net/ auto-blog-content.info/ keyword-stuffing-pro.com/ free-proxy-list.info/ spam-mailer-pro.net/ bulk-sms-blast.com/
psychic-reading-free.net/ love-spell-caster.info/ astrology-lucky-number.com/ miracle-cure-diabetes.net/ detox-tea-slim.com/ anti-aging-cream-trial.info/
""".split()

PLAIN = """
riverbendgazette.com/local/flood-plan oakfieldtimes.co.uk/ morgenblatt-nord.de/politik lejournalduport.fr/culture/12 diariodelvalle.es/deportes thewestcoastreader.com/2031/05/
stadtwerke-lindau.de/strom ayuntamiento-robledo.es/tramites mairie-saintaubin.fr/ecole cityofharlow.org/council/minutes countylibrary.info/catalogue parishregisters.org.uk/
winchester-museum.org/visit essex-walks.co.uk/routes/7 sussexdowns.net/map scunthorpe-band.org/ middlesex-choir.org/concerts adstock-village.co.uk/ 
freebsd-handbook.org/network freedomhistory.net/archive freeman-architects.com/projects gluten-free-kitchen.net/bread tax-free-shopping-rules.eu/faq freestyle-ski-club.ch/
betsy-knits.com/patterns bettina-keramik.de/ betelgeuse-astronomy.org/stars alphabet-games.net/kids diabetes-advice.org/diet elizabethan-plays.com/hamlet tibetan-art.info/
tracking-wolves.org/ railtrack-models.net/gauge soundtrack-reviews.com/2030 tractor-parts-ltd.co.uk/ trackandfield.info/records timetracker-docs.io/api
pillsbury-recipes.net/cake caterpillar-guide.org/species pillow-test.com/ spillway-engineering.com/dams capillary-flow.edu/lab pillar-of-salt.net/
farmhouse-cheese.com/ organicfarming.org/soil windfarm-data.eu/2029 farmersmarket-guide.com/ salmonfarms-report.no/ farmington-school.org/
winery-rosen.de/ windsor-castle-tours.com/ darwin-letters.org/1844 twinpeaks-hiking.net/ winterbourne.org.uk/ ventanas-y-ventanales.es/ godwin-family.net/tree
slotcar-racing.net/ timeslot-booking.org/help camshaft-engines.com/ webcam-birdbox.org/ cambridge-botany.org/ camping-am-see.de/ chicanery-novel.com/
cheapside-history.co.uk/ cheaper-heating.org/insulation adsorption-lab.edu/ leads-university-physics.ac.uk/ loads-and-bridges.com/calc threadstore.net/wool
spamalot-theatre.com/ hamandeggs.net/ spanish-grammar.info/ser-estar spartan-museum.gr/ adulthood-studies.org/ adult-education-centre.ie/courses
crack-in-the-wall.com/poems cracker-recipes.net/ firecracker-safety.org/ hackney-gardens.org.uk/ hackathon-school.edu/2030 lifehacks-for-parents.net/
casinotto-family.it/ cassini-mission.org/images casa-rural-encina.es/ castle-in-the-dunes.nl/ pokerface-choir.de/ polkadot-fabrics.com/
dating-rocks.edu/isotopes carbon-dating-lab.org/ update-notes.dev/changelog accommodating-spaces.org/ escortwagen-oldtimer.de/ sextant-navigation.com/ sextet-jazz.net/
lottery-grants-report.org/2028 sloth-rescue.org/ bonustrack-records.com/ bonn-uni-bibliothek.de/suche prizewinning-novels.org/list nobelprizes-history.org/1921
loan-exhibits-museum.org/ sloan-survey.edu/ student-loans-explained.gov/ creditunion-holm.coop/ accreditation-board.org/ cashmere-goats.com/ cashew-trees.org/
click-beetles.info/ clicker-training-dogs.com/ banner-making-guild.org/ popup-books.net/ popular-mechanics-club.com/ download-archive.museum/ 
python-tutorials.dev/lists rust-learning.org/book linux-kernel-notes.net/mm sql-puzzles.com/joins opendata-portal.gov/transport compiler-course.edu/week3
maths-olympiad.org/problems physics-lectures.ac.uk/waves biologie-lernen.de/zelle chimie-lycee.fr/ historia-antigua.es/roma geologie-alpen.ch/ 
kochbuch-oma.de/suppe recettes-de-mamie.fr/tarte cocina-andaluza.es/gazpacho sourdough-diary.com/day4 tea-of-assam.net/ beekeepers-journal.org/
trailrunning-north.com/ velo-touring.fr/loire wandern-eifel.de/route-9 sailing-logs.net/atlantic birdwatch-kent.org.uk/ rock-climbing-topo.com/
city-hospital.org/visitors pharmacy-college.edu/admissions zahnarzt-weber.de/ clinica-veterinaria-sol.es/ nurses-handbook.org/ apotheke-am-markt.de/notdienst
symphony-hall.com/season theatre-of-puppets.cz/ filmclub-metro.de/ photography-basics.net/light indie-games-review.com/ chess-openings.org/sicilian
baby-names-meaning.net/ knitting-circle.co.uk/ woodworkers-forum.com/t/112 vintage-radio-repair.net/ model-trains-forum.de/ garden-ponds.org/
insurance-law-review.edu/ central-bank-statistics.org/ accounting-standards.int/ startup-founders-letters.com/ small-business-advice.gov/tax patents-search.eu/
weather-station-kirk.no/ tide-tables.info/ avalanche-bulletin.ch/ earthquake-catalog.org/ air-quality-map.eu/ satellite-passes.net/
grace-church.org/sermons temple-architecture.in/ quaker-archives.org/ mosque-tours.net/ refugee-council.org/help foodbank-leeds.org.uk/
babotano.com/ lerusi.net/en/12 kinadova.info/ wepolir.org/ mundstaler.de/ ferioka.es/p/4 shantelu.com/about dorviken.net/ tulamesa.info/page/2 ongathi.com/
stonewall.net/es/44 nadavero.com/article/9 thimosa.info/ galenwi.de/ sirutano.fr/ pokalova.net/index.html ritheng.com/ meristopol.org/ havorin.co.uk/ jelunasta.info/
""".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) of all."""
    rows = []
    for label, urls in ((1, UNWANTED), (0, PLAIN)):
        for url in urls:
            host, slash, path = url.partition("/")
            rows.append((host, (slash + path).split("?")[0], label))
    return rows
