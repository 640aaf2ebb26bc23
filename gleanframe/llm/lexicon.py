"""Phrases of web pages in seven languages. All lists are fixed values: add a language by adding its lines.

Phrases are matched in lower case with white space squeezed; a form without accents is added by rule.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import ahocorasick

# Wording of notices that stand around a page's body (cookies, legal, sharing, subscriptions, jumps).
SURROUNDINGS = """
we use cookies to make | you can change your choice | stores small files on your device | choose which cookies we may set | you agree to the use of cookies | accept all cookies
may be reprinted without written consent | all rights reserved | takes no liability for linked pages | include sales tax unless
print this page | share this story from | with your friends | listen to this article ( | readers have shared this page | for more stories like this | read more below
morning letter | correction or question? | back to top | skip to main content | advertisement | terms of use
verwenden cookies, damit | speichert kleine dateien auf ihrem | welche cookies wir setzen | stimmen sie den cookies | alle annehmen ablehnen
nur mit schriftlicher zustimmung | alle rechte vorbehalten | haftet nicht für den inhalt verlinkter | enthalten die gesetzliche steuer
seite drucken | diesen beitrag von | mit freunden teilen | diesen artikel anhören ( | leser haben diese seite | und lesen sie mehr davon | weiter unten mehr
den morgenbrief von | fehler gefunden? | nach oben | zum inhalt springen | anzeige | nutzungsbedingungen | im monat unterstützen | kommentare bei
cookies pour faire fonctionner | dépose de petits fichiers sur votre | choisissez vos cookies | vous acceptez les cookies | tout accepter refuser
exige un accord écrit | tous droits réservés | décline toute responsabilité pour les pages | comprennent la taxe
imprimer cette page | partagez cet article de | avec vos amis | écoutez cet article ( | lecteurs de | ont partagé cette page | pour d'autres récits | d'autres récits | la suite plus bas
la lettre du matin | une erreur ? écrivez | haut de page | aller au contenu | publicité | mentions légales
usamos cookies para que | guarda pequeños archivos en su equipo | elija qué cookies acepta | usted acepta las cookies | aceptar todo rechazar
prohibida la copia de | todos los derechos reservados | no responde por las páginas enlazadas | incluyen impuestos
imprimir esta página | comparte esta noticia de | con tus amigos | escucha este artículo ( | compartieron esta página | para leer más historias | sigue más abajo
la carta matinal de | ¿ha visto un error? | volver arriba | ir al contenido | publicidad | aviso legal
usiamo i cookie per | salva piccoli file sul tuo dispositivo | scegli quali cookie | accetti i cookie di | accetta tutto rifiuta
vietata la copia di | tutti i diritti riservati | non risponde delle pagine collegate | comprendono le imposte
stampa questa pagina | condividi questa notizia di | con gli amici | ascolta questo articolo ( | hanno condiviso questa pagina | per altre storie | continua più sotto
la lettera del mattino | hai visto un errore? | torna su | vai al contenuto | pubblicità | note legali
guarda pequenos ficheiros no seu aparelho | escolha que cookies | ao continuar aceita os cookies | aceitar tudo recusar
proibida a cópia de | todos os direitos reservados | não responde pelas páginas ligadas | incluem imposto
partilhe esta notícia de | com os amigos | ouça este artigo ( | partilharam esta página | para mais histórias | continua mais abaixo
a carta da manhã de | viu um erro? | voltar ao topo | ir para o conteúdo | publicidade
gebruiken cookies om | bewaart kleine bestanden op uw apparaat | kies welke cookies | aanvaardt u de cookies | alles aanvaarden weigeren
alleen met schriftelijke toestemming | alle rechten voorbehouden | is niet aansprakelijk voor gelinkte | zijn met belasting
druk deze pagina af | deel dit bericht van | met vrienden | beluister dit artikel ( | deelden deze pagina | voor meer verhalen | hieronder meer
de ochtendbrief van | een fout gezien? | naar boven | ga naar de inhoud | advertentie | colofon | privacy matters to | daten sind | vie privée compte pour | privacidad importa a | la privacidad | privacy conta per | privacidade importa
uses cookies | use cookies and | cookies and similar technologies | read more | posted in | filed under | tags: | view our privacy
verwendet cookies | cookies und ähnliche technologien | für unseren newsletter | weiterlesen | mehr erfahren | schlagwörter: | veröffentlicht in
utilise des cookies | cookies et technologies similaires | à notre newsletter | lire la suite | en savoir plus | publié dans | mots-clés :
utiliza cookies | cookies y tecnologías similares | a nuestro boletín | leer más | seguir leyendo | publicado en | etiquetas:
utilizza cookie | cookie e tecnologie simili | alla nostra newsletter | leggi tutto | per saperne di più | pubblicato in | etichette:
cookies e tecnologias semelhantes | a nossa newsletter | ler mais | saiba mais | publicado em
gebruikt cookies | cookies en vergelijkbare technieken | voor onze nieuwsbrief | lees meer | lees verder | geplaatst in | trefwoorden:
"""  # fmt: skip

# Words of menus, notices, prompts and side boxes, by language (en de fr es it pt nl), as sites of any kind use them.
SIGNS = """
cookie cookies newsletter newsletters facebook twitter whatsapp linkedin pinterest instagram telegram youtube reddit email e-mail rss feed pdf copyright sitemap faq blog login logout javascript spam premium podcast podcasts app online gdpr dsgvo rgpd
subscribe subscription subscribers unsubscribe sign signup register account accounts password share shared sharing follow print download comment comments reply replies careers press advertise advertising advertisement sponsored related recommended trending popular articles stories posts headlines website privacy policy preferences consent settings reserved terms conditions disclaimer imprint accessibility skip navigation menu previous next tags categories category about contact home browser
abonnieren abonnement registrieren konto passwort teilen drucken herunterladen kommentar kommentare kommentieren antworten karriere presse werbung anzeige anzeigen gesponsert ähnliche empfohlen beliebt artikel beiträge schlagzeilen webseite website datenschutz datenschutzerklärung einwilligung einstellungen zustimmen vorbehalten rechte agb impressum barrierefreiheit überspringen navigation vorherige nächste schlagwörter kategorien kontakt startseite folgen merkliste
abonner abonnez abonnement inscription inscrire inscrivez compte passe partager partagez imprimer télécharger commentaire commentaires commenter répondre carrières presse publicité sponsorisé similaires recommandés populaires articles site confidentialité politique préférences consentement paramètres accepter réservés mentions légales accessibilité navigation précédent suivant étiquettes catégories contact accueil suivre suivez
suscribir suscríbete suscribirse suscripción boletín registrarse cuenta contraseña compartir comparte imprimir descargar comentario comentarios comentar responder empleo prensa publicidad patrocinado relacionados relacionadas recomendados populares artículos noticias sitio web privacidad política preferencias consentimiento configuración aceptar reservados aviso legal accesibilidad navegación anterior siguiente etiquetas categorías contacto inicio seguir síguenos
abbonati abbonamento iscriviti registrati account password condividi stampa scarica commento commenti commenta rispondi carriere pubblicità sponsorizzato correlati correlate consigliati popolari articoli sito riservatezza politica preferenze consenso impostazioni accetta riservati note legali accessibilità navigazione precedente successivo etichette categorie contatti seguici
assinar assine subscrever subscreva inscreva registar conta senha partilhar partilhe compartilhar compartilhe imprimir descarregar baixar comentário comentários comentar responder carreiras imprensa publicidade patrocinado relacionados relacionadas recomendados populares artigos site privacidade política preferências consentimento definições aceitar reservados avisos legais acessibilidade navegação anterior seguinte etiquetas categorias contacto contato início seguir siga
abonneren abonneer inschrijven registreren account wachtwoord delen deel afdrukken downloaden reactie reacties reageer reageren vacatures pers advertentie advertenties gesponsord gerelateerde gerelateerd aanbevolen populair artikelen berichten website privacybeleid voorkeuren toestemming instellingen accepteren voorbehouden voorwaarden toegankelijkheid navigatie vorige volgende trefwoorden categorieën contact startpagina volg
"""  # fmt: skip

# Further words of footers and prompts (rights, liability, prices, places of service), in the same order.
SERVICE = """
reprint reprinted reproduction written permission liability liable linked prices tax taxes vat phone fax registered listen readers minutes top print page correction feedback mistake agree device files
nachdruck schriftlicher genehmigung zustimmung haftet haftung verlinkter verlinkte inhalt preise steuer mehrwertsteuer telefon sitz hören minuten leser seite drucken oben korrektur gerät dateien annehmen
reprise reproduction écrit accord décline responsabilité liées prix taxe taxes tva téléphone siège écoutez minutes lecteurs page imprimer haut correction appareil fichiers erreur rédaction
copia reproducción permiso escrito responde enlazadas precios impuestos iva teléfono sede escucha minutos lectores página imprimir arriba corrección equipo archivos error redacción
copia riproduzione consenso scritto risponde responsabilità collegate prezzi imposte iva telefono sede ascolta minuti lettori pagina stampare su correzione dispositivo file errore redazione
cópia reprodução licença escrita responde responsabilidade ligadas preços imposto iva telefone sede ouça minutos leitores página imprimir topo correção aparelho ficheiros erro redação
overname schriftelijke toestemming aansprakelijk gelinkte prijzen belasting btw telefoon zetel beluister minuten lezers pagina afdrukken boven correctie apparaat bestanden fout redactie
"""  # fmt: skip

# Words of notices that stand in a page's place (errors, refusals, checks, missing scripts), in the same order.
TROUBLE = """
error denied forbidden permission access blocked unavailable busy server page found find exist exists scripts script javascript enable enabled disabled reload refresh browser verify human robot captcha try again later wrong loading temporarily request account requires require needs need allow continue cannot settings security connection session expired supported turn
fehler zugriff verweigert gesperrt berechtigung server überlastet seite gefunden existiert skripte skript javascript aktivieren aktiviert deaktiviert eingeschaltet neu browser bestätigen mensch roboter versuchen später erneut vorübergehend erreichbar verfügbar anfrage konto benötigt braucht erlauben fortfahren fortzufahren einstellungen verbindung sitzung abgelaufen unterstützt dürfen schiefgegangen
erreur accès refusé interdit bloqué serveur occupé page introuvable trouvée existe scripts script javascript activer activez activé désactivé recharger rechargez navigateur confirmer vérifier humain robot réessayer réessayez tard indisponible temporairement chargement compte demande besoin exige autorisez autoriser continuer paramètres connexion session expirée droit problème
error acceso denegado prohibido bloqueado permiso servidor ocupado página encontró encontrada existe scripts javascript activar active desactivado recargue recargar navegador confirme verificar persona humano robot inténtelo intente tarde disponible cuenta solicitud necesita requiere permita continuar ajustes conexión sesión caducado falló
errore accesso negato vietato bloccato permesso server occupato pagina trovata esiste script javascript attiva attivare abilita abilitare disattivato ricarica browser conferma verifica persona umano robot riprova tardi disponibile account richiesta richiede consenti continuare impostazioni connessione sessione scaduta puoi funzionato
erro acesso negado proibido bloqueado permissão servidor ocupado página encontrada existe scripts javascript ligue ligar ative ativar desativado recarregue navegador confirme verificar pessoa humano robô tente tarde disponível indisponível conta pedido precisa preciso requer permita continuar definições ligação sessão expirou correu
fout toegang geweigerd verboden geblokkeerd toestemming server bezet pagina gevonden bestaat scripts javascript schakel inschakelen uitgeschakeld herlaad browser bevestig verifiëren mens robot probeer opnieuw later bereikbaar beschikbaar account verzoek nodig vereist continueren instellingen verbinding sessie verlopen mag mis
"""  # fmt: skip

# Words that bear no content beside signs, so that a short line of them and one sign is a prompt.
FILLING = """
a all an and for in more my new of on our post the this to up us use uses using via we with you your leave write join read now here be first see view experience improve
alle auf das dem den der die diese dieser ein eine einen für hier ihr ihre in jetzt mehr mit neue oder sie uns unsere und von wir zu zum zur schreiben hinterlassen verwendet nutzt
au aux avec ce cette de des du en et ici la le les l maintenant nos notre nous ou par plus pour sur un une votre vos écrire laisser laissez utilise
a al aquí con de del deja dejar e el en esta este la las los más nuestra nuestro o para por su sus tu un una y ya escribe utiliza usa
a ai al alla con da dei del della di e i il in la le lascia lo nostra nostro o ora per più qui scrivi su sul tuo un una usa utilizza vostro
a ao aos agora as com da das de deixe do dos e em escreva mais na no nossa nosso o os ou para por seu sua um uma usa utiliza aqui
aan alle de deze dit een en hier het in je jouw laat meer met nieuwe nu of om onze op ons over schrijf te uw van via voor achter gebruikt
"""  # fmt: skip

# Openings and closings of prompts whose middle is a name or a number, as regular expressions on the whole line.
PROMPTS = r"""
^read \d+ comments? on |^support [^.!?]+? from \d+ a month|^sign up for the [^.!?]+? letter|^follow [^.!?]+? for more|^prices on
^lire \d+ commentaires? sur |^soutenez [^.!?]+? dès \d+ par mois|^suivez [^.!?]+? pour|^les prix de [^.!?]+? taxe
^leer \d+ comentarios? en |^apoya a [^.!?]+? desde \d+ al mes|^sigue a [^.!?]+? para|^los precios de [^.!?]+? impuestos
^leggi \d+ commenti su |^sostieni [^.!?]+? da \d+ al mese|^segui [^.!?]+? per altre|^i prezzi di [^.!?]+? imposte
^ler \d+ comentários em |^apoie [^.!?]+? desde \d+ por mês|^siga [^.!?]+? para mais|^os preços de [^.!?]+? imposto
^lees \d+ reacties op |^steun [^.!?]+? vanaf \d+ per maand|^volg [^.!?]+? voor meer|^prijzen van [^.!?]+? belasting|^ontvang de [^.!?]+? van
^\d+ kommentare bei [^.!?]+? lesen|^[^.!?]+? ab \d+ im monat |^folgen sie [^.!?]+? und lesen|^alle preise bei
^(?:registered office of|sitz von|siège de|sede de|sede di|zetel van) [^.!?]+?:|^© ?\d{4} |^copyright |^\(c\) \d{4}
"""  # fmt: skip

# Bylines, with a name where the dots are.
BYLINES = r"""
^(?:by|von|par|por|di|door) \S+(?: \S+){0,5}, [^.!?;:\s]+(?: [^.!?;:\s]+){0,4}$
^(?:text|texte|texto|testo|tekst) ?: [^!?;:]{3,}$
^[^|]{3,} \| [^|]{3,} \| (?:updated|aktualisiert|geändert|stand|mis à jour|actualizado|aggiornato|atualizado|bijgewerkt) \S+(?: \S+){0,3}$
"""  # fmt: skip

# Names of a site's sections and service pages.
MENU = """
home, news, sport, sports, culture, weather, contact, help, letters, events, archive, archives, photos, shop, search, jobs, log in, login, sign in, about us, imprint, privacy, settings, accept all, reject, menu
startseite, nachrichten, kultur, wetter, kontakt, hilfe, leserbriefe, termine, archiv, bilder, laden, suche, suchen, stellen, anmelden, über uns, impressum, datenschutz, einstellungen, alle annehmen, ablehnen
accueil, actualités, météo, courrier, agenda, boutique, recherche, emplois, connexion, à propos, aide, vie privée, conditions, réglages, tout accepter, refuser
inicio, noticias, deportes, cultura, tiempo, contacto, ayuda, cartas, archivo, fotos, tienda, buscar, empleo, entrar, quiénes somos, privacidad, condiciones, ajustes, aceptar todo, rechazar
pagina iniziale, notizie, meteo, contatti, aiuto, lettere, eventi, archivio, foto, negozio, cerca, lavoro, accedi, chi siamo, riservatezza, condizioni, impostazioni, accetta tutto, rifiuta
início, notícias, desporto, tempo, ajuda, arquivo, loja, procurar, empregos, sobre nós, privacidade, condições, definições, aceitar tudo, recusar
voorpagina, nieuws, cultuur, weer, hulp, brieven, archief, beelden, winkel, zoeken, vacatures, inloggen, over ons, voorwaarden, instellingen, alles aanvaarden, weigeren
"""  # fmt: skip

# Headings of lists of other articles.
RELATED = """
related stories | you may also like | more from this section | most read | latest headlines | read next
verwandte artikel | das könnte sie auch interessieren | mehr aus diesem ressort | meistgelesen | neueste meldungen
à lire aussi | vous aimerez aussi | plus dans cette rubrique | les plus lus | derniers titres | dernières nouvelles | articles liés
noticias relacionadas | también te puede gustar | más de esta sección | lo más leído | últimos titulares
articoli correlati | potrebbe interessarti | altro da questa sezione | i più letti | ultime notizie | ultimi titoli
artigos relacionados | também pode gostar | mais desta secção | mais lidas | as mais lidas | mais lidos | os mais lidos | últimas notícias | últimos títulos
verwante artikelen | dit vindt u misschien ook | meer uit deze rubriek | meest gelezen | laatste koppen | laatste nieuws | misschien ook interessant | misschien ook iets voor u
"""  # fmt: skip

# Parts of notices that stand in a page's place: errors, refusals, checks and missing scripts.
NOTICES = """
could not be found on this server | the server is busy. request | is denied. your request was blocked | this page requires scripts | turn them on in your browser settings | something went wrong while we were loading | please try again later
internal error. | can't find the page you are looking for | no longer exists. | if nothing happens, allow scripts | you must turn on javascript to read | scripts are disabled, so | enable them and reload | you do not have permission to view this page
please verify that you are human | is temporarily unavailable ( | needs javascript. your browser | please enable javascript to | service unavailable | not found | please come back in a few minutes | access denied. | this account or page (
wurde auf diesem server nicht gefunden | benötigt skripte. | erlauben sie sie im browser und laden | ist leider etwas schiefgegangen | bitte versuchen sie es später | interner fehler. | diese seite gibt es nicht mehr | der zugriff auf | zugriff verweigert.
bitte aktivieren sie javascript | braucht javascript. ihr browser | muss javascript eingeschaltet sein | sie dürfen diese seite nicht ansehen | bitte bestätigen sie, dass sie ein mensch | ist vorübergehend nicht erreichbar | seite nicht gefunden | bitte später noch einmal versuchen | dienst nicht verfügbar | der server ist überlastet | wurde verweigert. | dieses konto oder diese seite (
est introuvable sur ce serveur | a besoin de scripts. | autorisez-les puis rechargez | un problème est survenu pendant le chargement | réessayez plus tard | erreur interne. | merci de réessayer plus tard | accès refusé. | vous n'avez pas le droit de voir cette page
veuillez activer javascript | exige javascript, or votre navigateur | il faut activer javascript pour lire | merci de confirmer que vous n'êtes pas un robot | est temporairement indisponible | page introuvable | n'existe plus. | l'accès à | est refusé. | ce compte ou cette page ( | service indisponible
no se encontró la página | en este servidor. | esta página necesita scripts | permítalos y vuelva a cargar | algo falló al cargar | inténtelo más tarde | inténtelo de nuevo más tarde | error interno. | el acceso a | está prohibido. | acceso denegado. | no tiene permiso para ver esta página
active javascript para continuar | necesita javascript y su navegador | hay que activar javascript | confirme que es una persona | no está disponible por ahora | página no encontrada | ya no existe. | esta cuenta o página ( | servicio no disponible
non è stata trovata su questo server | questa pagina richiede gli script | consentili e ricarica | qualcosa non ha funzionato caricando | riprova più tardi | errore interno. | l'accesso a | accesso negato. | non puoi vedere questa pagina
attiva javascript per continuare | devi attivare javascript | richiede javascript | conferma di essere una persona | al momento non è disponibile | pagina non trovata | non esiste più. | è negato. | è vietato. | questo account o questa pagina ( | servizio non disponibile
não foi encontrada neste servidor | esta página precisa de scripts | permita-os e recarregue | algo correu mal ao carregar | tente mais tarde | tente de novo mais tarde | erro interno. | o acesso a | acesso negado. | não tem licença para ver esta página
ligue o javascript para continuar | é preciso ligar o javascript | precisa de javascript | confirme que é uma pessoa | está temporariamente indisponível | página não encontrada | já não existe. | está proibido. | foi negado. | esta conta ou página ( | serviço indisponível
is niet gevonden op deze server | deze pagina heeft scripts nodig | sta ze toe en herlaad | er ging helaas iets mis bij het laden | probeer het later opnieuw | interne fout. | de toegang tot | toegang geweigerd. | u mag deze pagina niet bekijken
schakel javascript in om verder te gaan | zet javascript aan om | heeft javascript nodig | bevestig dat u een mens bent | is tijdelijk niet bereikbaar | pagina niet gevonden | bestaat niet meer. | is geweigerd. | is verboden. | dit account of deze pagina ( | dienst niet beschikbaar
"""  # fmt: skip

# Messages of servers, gateways and unfinished pages that count where they make up most of a line.
MESSAGES = """
400 bad request | 401 unauthorized | 403 forbidden | 404 not found | 405 method not allowed | 408 request timeout | 410 gone | 429 too many requests | 500 internal server error | 502 bad gateway | 503 service unavailable | 504 gateway timeout | bad gateway | gateway timeout | bad request | too many requests | internal server error
the requested url was not found | the page you requested could not be found | this page does not exist | this page isn't available | this content is not available | the page cannot be displayed | connection timed out | connection refused | this site can't be reached | your session has expired | please log in again | please sign in to continue | you are not authorized | access to this page has been denied | sorry, you have been blocked | you have been blocked | unusual traffic
checking your browser before accessing | checking your browser | just a moment | verifying you are human | verify you are human | are you a robot | i am not a robot | complete the captcha | enable cookies | you need to enable javascript to run | enable javascript | javascript is disabled | javascript is required | requires javascript | please wait while your request | request is being verified | please wait while | redirecting | you will be redirected | using automation tools | update your browser | browser is not supported
coming soon | under construction | site is under maintenance | undergoing scheduled maintenance | account suspended | this domain is for sale | domain is parked | default web page | it works! | no results found | nothing found | placeholder text | content goes here | insert text here | add your text here | description goes here | title goes here | this is a sample page | edit or delete it | dummy text
fehler 404 | fehler 403 | fehler 500 | interner serverfehler | diese seite existiert nicht | seite existiert nicht | seite konnte nicht gefunden werden | ihre sitzung ist abgelaufen | zu viele anfragen | sind sie ein roboter | javascript aktivieren | javascript ist deaktiviert | im aufbau | demnächst verfügbar | wartungsarbeiten | hier text einfügen | platzhaltertext | ihr text hier
erreur 404 | erreur 403 | erreur 500 | erreur interne du serveur | cette page n'existe pas | la page demandée est introuvable | votre session a expiré | trop de requêtes | êtes-vous un robot | activer javascript | javascript est désactivé | en construction | bientôt disponible | en maintenance | insérez votre texte ici | votre texte ici | texte de remplacement
error 404 | error 403 | error 500 | error interno del servidor | esta página no existe | la página solicitada no existe | su sesión ha caducado | demasiadas solicitudes | es usted un robot | activar javascript | javascript está desactivado | en construcción | próximamente | en mantenimiento | inserte su texto aquí | su texto aquí | texto de relleno
errore 404 | errore 403 | errore 500 | errore interno del server | questa pagina non esiste | la pagina richiesta non esiste | la sessione è scaduta | troppe richieste | sei un robot | abilitare javascript | javascript è disattivato | in costruzione | prossimamente | in manutenzione | inserisci qui il testo | il tuo testo qui | testo segnaposto
erro 404 | erro 403 | erro 500 | erro interno do servidor | esta página não existe | a página solicitada não existe | a sua sessão expirou | demasiados pedidos | é um robô | ativar javascript | javascript está desativado | em construção | em breve | em manutenção | insira o texto aqui | o seu texto aqui | texto de preenchimento
fout 404 | fout 403 | fout 500 | interne serverfout | deze pagina bestaat niet | de opgevraagde pagina bestaat niet | uw sessie is verlopen | te veel verzoeken | bent u een robot | javascript inschakelen | javascript is uitgeschakeld | in aanbouw | binnenkort beschikbaar | in onderhoud | voeg hier tekst toe | uw tekst hier | opvultekst
"""  # fmt: skip

# Beginnings of placeholders, where their full shape is then checked.
SLOTS = "{{ {% <% ${ #{ $!{ #!{ { [[ << < [% %% % @@ __ *| xx_ xxx_ xxxx_ ~~ && %( $ [insert [your [enter [add here] todo: fixme: tk:"

# Sentences that only hold the place of text to come; a name may stand where the ellipsis is.
FILLERS = """
insert the introduction of … here | is only a placeholder and will be replaced | sample text for … please do not publish | write two or three sentences about … goes live | your headline for … goes here | text to come | your text here
hier steht später die einleitung | dieser absatz über … nur ein platzhalter | dieser absatz über … vorläufig | mustertext für … bitte nicht veröffentlichen | schreiben sie zwei oder drei sätze über
placez ici l'introduction de | ce paragraphe sur … est provisoire et sera remplacé | texte d'exemple pour … ne pas publier | écrivez deux ou trois phrases sur
ponga aquí la introducción de | este párrafo sobre … es provisional y será cambiado | texto de muestra para … no publicar | escriba dos o tres frases sobre
inserisci qui l'introduzione di | questo paragrafo su … provvisorio | testo di prova per … non pubblicare | testo di esempio per … non pubblicare | scrivi due o tre frasi su
escreva aqui a introdução de | este parágrafo sobre … é provisório e será | texto de exemplo para … não publicar | escreva duas ou três frases sobre
zet hier de inleiding van | deze alinea over … is voorlopig en wordt vervangen | voorbeeldtekst voor … niet publiceren | schrijf twee of drie zinnen over
"""  # fmt: skip

# The words of the printers' pseudo-Latin passage.
PSEUDO_LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
magnus estor quisque tellus animi
""".split()


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def phrases(block: str, sep: str = "|") -> list[str]:
    """The entries of one of the lists above, each also without accents."""
    found = [x.strip() for line in block.strip().splitlines() for x in line.split(sep)]
    found = [x for x in found if x]
    return list(dict.fromkeys([*found, *map(plain, found)]))


@cache
def latin_stems() -> frozenset[str]:
    """Beginnings of five letters (or the whole word) of the pseudo-Latin words of four letters or more."""
    return frozenset(w[:5] for w in PSEUDO_LATIN if len(w) >= 4)


@cache
def automaton() -> ahocorasick.Automaton:
    """One automaton over surroundings, notices, messages, fillers, pseudo-Latin and the beginnings of placeholders; a hit
    gives (length, [(kind, all parts in order)])."""
    found: dict[str, list] = {}
    for kind, block in (("around", SURROUNDINGS), ("notice", NOTICES), ("message", MESSAGES), ("filler", FILLERS)):
        for p in phrases(block):
            parts = [x.strip() for x in p.split("…")]
            found.setdefault(parts[0], []).append((kind, parts))
    for kind, heads in (("slot", SLOTS.split()), ("latin", latin_stems())):
        for p in heads:
            found.setdefault(p, []).append((kind, [p]))
    a = ahocorasick.Automaton()
    for head, entries in found.items():
        a.add_word(head, (len(head), entries))
    a.make_automaton()
    return a
