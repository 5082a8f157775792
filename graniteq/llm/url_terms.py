"""The default vocabulary of URL terms, as text: a weight, a topic, and terms.

A URL whose distinct terms together weigh REJECT_WEIGHT or more is rejected, so a
strict term (2) rejects by itself and soft terms (1), which also stand in
harmless URLs, only together.
"""

REJECT_WEIGHT = 2

VOCABULARY = """
2 adult: porn porno pornos pornography pornstar pornstars pornhub pornvideo pornvideos freeporn xxx xxxvideo xxxvideos xvideos xnxx xhamster redtube youporn hentai milf milfs
2 adult: camgirl camgirls camsex sexcam sexcams sexchat sexshop sextape sextapes sexvideo sexvideos livesex freesex webcamsex escortgirl escortgirls escort escorts callgirl callgirls stripclub stripclubs
2 adult: bdsm blowjob blowjobs bukkake cumshot cumshots deepthroat gangbang gangbangs handjob onlyfansleaks nsfw hotgirls sexgirls nudegirls nakedgirls hookups sugarbaby sugardaddy swingers upskirt
2 gambling: casino casinos onlinecasino livecasino casinobonus freespins freespin slotmachine slotmachines slotonline onlineslots judi togel bandarq sportsbook sportsbooks bookmaker bookmakers pokerstars
2 gambling: betting1x bet365 1xbet 22bet onlinebetting onlinepoker onlineroulette pachinko bitcasino cryptocasino
2 drugs: viagra cialis levitra kamagra sildenafil tadalafil vardenafil phentermine xanax tramadol oxycontin buyviagra buycialis cheapviagra onlinepharmacy canadianpharmacy buysteroids
2 piracy: warez keygen keygens crackz serialz nulled nulledscripts fulldownload freecrack crackedsoftware piratebay thepiratebay moviez mp3z camrip
2 malware: malware phishing keylogger keyloggers ransomware botnet botnets stealer spyware scareware rootkit exploitkit carding cvvshop fullz dumpshop
2 spam: spam spammer spammers spamfarm linkfarm linkfarms adfarm doorwaypages clickfarm splog scraperstats buybacklinks buyfollowers buylikes paidlinks
2 fraud: paydayloan paydayloans cashadvance getrichquick ponzi doubleyourmoney fakeid fakepassport fakediploma essaymill essaywriters replicawatches fakewatches
1 adult: adult adults erotic erotica sex sexy nude nudes naked lingerie fetish kinky lesbian lesbians webcam webcams hot girls dating singles hookup affair stripper strippers topless uncensored
1 gambling: poker bet bets betting gambling gamble jackpot jackpots roulette blackjack baccarat lottery lotto bingo wager wagers slots slot odds bookie bookies
1 drugs: pills pill pharma pharmacy drugs steroids weightloss detox cbd kratom vape enlargement erection prescription
1 piracy: torrent torrents crack cracks cracked serial serials unlocked modapk apk iptv leaked leaks rip rips
1 money: loan loans payday credit cash cheap cheapest coupon coupons deal deals discount discounts bonus bonuses win winner winners prize prizes giveaway giveaways earn forex crypto bitcoin binary millionaire
1 spam: ad ads adserver advert banner click clicks clickhere farm free freebie freebies offer offers popup popunder promo promos track tracker tracking redirect referral affiliate affiliates backlink backlinks seo traffic
1 goods: replica replicas outlet wholesale knockoff knockoffs rolex handbags ugg louisvuitton
"""


def terms(weight: int) -> tuple[str, ...]:
    """The distinct terms of a weight, in order."""
    found: dict[str, None] = {}
    for line in VOCABULARY.strip().splitlines():
        own, _, words = line.partition(": ")
        if int(own.split()[0]) == weight:
            found.update(dict.fromkeys(words.split()))
    return tuple(sorted(found))
