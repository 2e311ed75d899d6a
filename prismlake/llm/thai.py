"""Thai words by part of speech: a general list for reading the gaps of Thai text.

A versioned resource, written by hand; it covers everyday, news and legal wording, not all of the language. A clause whose
only verb is missing here is seen only by its subject, see predicate(). Raise VERSION with every change of the list.
"""

from __future__ import annotations

VERSION = 1

# Verbs that can be the predicate of a clause, auxiliaries that always stand with one included.
VERB = frozenset("""
ไป มา ทำ อยู่ ใช้ มี เป็น คือ ได้ ต้อง ควร ขอ เห็น ดู มอง ฟัง ได้ยิน พูด บอก ถาม ตอบ เล่า คุย เรียก ร้อง ร้องเพลง ตะโกน กล่าว ชี้แจง อธิบาย แถลง ประกาศ รายงาน เปิดเผย
ระบุ ยืนยัน เสนอ แนะนำ เตือน สัญญาว่า รับปาก เชื่อ คิด คาด คาดว่า หวัง รู้ รู้จัก รู้สึก ทราบ เข้าใจ จำ ลืม นึก สงสัย กลัว รัก ชอบ เกลียด อยาก ต้องการ ปรารถนา สนใจ ตั้งใจ ตัดสินใจ
กิน ทาน ดื่ม รับประทาน นอน หลับ ตื่น ลุก นั่ง ยืน เดิน วิ่ง ว่าย ว่ายน้ำ บิน ขับ ขี่ เดินทาง เที่ยว ท่องเที่ยว กลับ ออก เข้า ขึ้น ลง ถึงที่ ผ่าน ข้าม หนี ตาม ติดตาม พบ เจอ หา ค้นหา ค้นพบ หาย
ซื้อ ขาย จ่าย ชำระ รับ ส่ง ให้ยืม ยืม เช่า จอง สั่ง สั่งซื้อ แลก คืน มอบ ถวาย แจก บริจาค เก็บ สะสม ลงทุน ผลิต สร้าง ก่อสร้าง ซ่อม แก้ แก้ไข ปรับ ปรับปรุง พัฒนา เปลี่ยน เปลี่ยนแปลง เพิ่ม เพิ่มขึ้น ลด ลดลง
เริ่ม เริ่มต้น จบ สิ้นสุด หยุด เลิก ดำเนินการ ดำเนิน จัด จัดการ จัดงาน เปิด ปิด เตรียม วางแผน ประชุม ตรวจ ตรวจสอบ สำรวจ ศึกษา วิจัย เรียน สอน อ่าน เขียน วาด แปล นับ คำนวณ วัด ทดลอง ทดสอบ สอบ ฝึก
ช่วย ช่วยเหลือ ดูแล รักษา ป้องกัน ปกป้อง คุ้มครอง สนับสนุน ร่วม ร่วมมือ เข้าร่วม แข่ง แข่งขัน ชนะ แพ้ เล่น หัวเราะ ยิ้ม ร้องไห้ เต้น เต้นรำ
เกิด เกิดขึ้น ตาย เสียชีวิต เจ็บ ป่วย บาดเจ็บ ชน ระเบิด ไหม้ พัง ล้ม ตก แตก หัก ขาด ท่วม พัด ไหล ลอย จม ปรากฏ พบว่า กลาย กลายเป็น ดูเหมือน เหมือน ต่าง แตกต่าง
ตั้ง ตั้งอยู่ วาง แขวน ยก ถือ จับ ดึง ผลัก ตัด หั่น ล้าง ซัก ถู กวาด ทำความสะอาด ต้ม ทอด ผัด ปรุง ทำอาหาร ใส่ ถอด สวม แต่งตัว อาบน้ำ แปรง ปลูก รดน้ำ เลี้ยง เก็บเกี่ยว ฆ่า ยิง ตี ต่อสู้ โจมตี
เข้าใจผิด ทำงาน พักผ่อน พัก รอ คอย ต้อนรับ เชิญ ชวน โทร โทรศัพท์ ติดต่อ ตกลง ยอม ยอมรับ อนุญาต อนุมัติ ห้าม บังคับ กำหนด ออกกฎหมาย เลือก เลือกตั้ง แต่งตั้ง แต่งงาน หย่า เกษียณ ลาออก สมัคร จ้าง ไล่ออก
เห็นว่า เห็นด้วย อ้าง โต้แย้ง ยื่น ลงนาม พ้น พิสูจน์ ถูกต้อง พิพากษา วินิจฉัย ให้การ ปฏิเสธ ฟ้อง อุทธรณ์ จับกุม สอบสวน ลงโทษ ละเมิด กระทำ บัญญัติ มีผล ชดใช้ เรียกร้อง เพิกถอน ยกเลิก ยกฟ้อง ประกอบ ประกอบด้วย
แสดง แสดงให้เห็น หมายถึง หมายความ เกี่ยวข้อง ขึ้นอยู่กับ เนื่อง ส่งผล ทำให้ ก่อให้เกิด นำ นำเข้า ส่งออก พา พาไป แบ่ง แยก รวม รวบรวม เชื่อม เชื่อมต่อ ติดตั้ง ดาวน์โหลด พิมพ์ กด คลิก บันทึก ลบ ค้าง
เชิญชวน โอน โอนย้าย ขยาย พุ่ง เร่ง สูบ ฉีด ผ่าตัด จด จดทะเบียน ซ้อม แสดงความ ปรบมือ ทอ เย็บ ถัก อบ ย่าง นึ่ง เท ตวง กรอง ขุด เจาะ ทุบ ทาสี ตอก เลื่อย มัด ห่อ แกะ ปอก จุด ดับ เผา ส่อง ฉาย ถ่าย ถ่ายรูป อัด
ค้นคว้า วิเคราะห์ ประเมิน เปรียบเทียบ อภิปราย โต้เถียง ทะเลาะ ตำหนิ ชม ชมเชย วิจารณ์ ร้องเรียน ประท้วง ชุมนุม เจรจา ต่อรอง หารือ ปรึกษา โหวต ลงคะแนน ปกครอง บริหาร ควบคุม กำกับ สั่งการ ออกคำสั่ง ประกาศใช้ บังคับใช้
ขโมย ปล้น โกง หลอกลวง ข่มขู่ ทำร้าย ฆาตกรรม ลักพาตัว หลบหนี ซ่อน ปล่อย ปล่อยตัว ขัง จำคุก ปรับเงิน ริบ ยึด อายัด ล้มละลาย กู้ กู้ยืม ออม ถอน ฝาก ค้ำประกัน จำนอง ประมูล โฆษณา จำหน่าย บรรจุ ขนส่ง
อพยพ ลี้ภัย ปะทะ บุก ถอย ยึดครอง ยอมแพ้ เจริญ เสื่อม ละลาย เดือด แข็งตัว ระเหย สั่น กระโดด คลาน ปีน กลิ้ง หมุน เลี้ยว จอด แซง เร่งความเร็ว หลง หลงทาง สะดุด ลื่น กัด เห่า ต่อย จิก กอด จูบ จับมือ ไหว้ กราบ
อาศัย ย้าย เติบโต โต อายุ สามารถ น่าจะ พยายาม ประสบ ประสบความสำเร็จ ล้มเหลว สำเร็จ ชื่อ เหลือ หมด เสีย เสียหาย เสร็จ พร้อม ขาดแคลน ได้รับ ประทับใจ ขอบคุณ ขอโทษ สวัสดี กรุณา โปรด ระวัง
""".split())
# Words of state: a predicate only beside a word that makes them one, else part of a noun phrase.
STATE = frozenset("""
ดี สวย งาม ใหญ่ เล็ก สูง เตี้ย ยาว สั้น กว้าง แคบ หนา บาง หนัก เบา ร้อน หนาว เย็น อุ่น แพง ถูก ง่าย ยาก เร็ว ช้า ใหม่ เก่า สะอาด สกปรก อร่อย หวาน เค็ม เปรี้ยว เผ็ด สด สุก ดิบ
มาก น้อย เยอะ ไกล ใกล้ ลึก ตื้น แข็ง นุ่ม แห้ง เปียก สว่าง มืด เงียบ ดัง สนุก เบื่อ เหนื่อย หิว อิ่ม ดีใจ เสียใจ โกรธ ตกใจ สบาย สุข เศร้า เก่ง ฉลาด โง่ ขยัน ขี้เกียจ ใจดี สำคัญ จำเป็น แน่นอน ชัดเจน
ปลอดภัย อันตราย แข็งแรง อ่อนแอ รวย จน ว่าง ยุ่ง เต็ม เหมาะสม เพียงพอ นาน บ่อย จริง ผิด ดำ ขาว แดง เขียว เหลือง สีฟ้า
""".split())
# Before a verb: denial, time and manner of the predicate.
AUX = frozenset("ไม่ จะ กำลัง เคย ยัง คง มัก อาจ ย่อม เพิ่ง ได้แต่ ค่อย ต่าง ล้วน ไม่ได้ ไม่เคย ก็ จึง แทบ เกือบ".split())
DEGREE = frozenset("มาก มากๆ จัง ที่สุด เกินไป พอ กว่า ขึ้น ลง อย่างยิ่ง นัก เหลือเกิน แล้ว อยู่ เสมอ ทีเดียว".split())
THIS = frozenset("นี้ นั้น โน้น นี่ นั่น เหล่านี้ เหล่านั้น ดังกล่าว".split())
PRONOUN = frozenset("ฉัน ผม ดิฉัน เรา พวกเรา เขา เธอ มัน ท่าน คุณ พวกเขา ข้าพเจ้า หนู ใคร อะไร ทุกคน บางคน ตนเอง".split())
# Close a clause at its end.
FINAL = frozenset("แล้ว ครับ ค่ะ คะ นะ เทอญ ด้วย เลย จ้ะ จ๊ะ จ้า สิ ซิ ล่ะ ไหม มั้ย หรือเปล่า หรือไม่ เถอะ เถิด หรอก นะครับ นะคะ".split())
# Something must follow these.
EXPECT = frozenset("""
คือ เมื่อ วันที่ ที่ ว่า กับ และ หรือ ของ จาก ถึง โดย ใน เป็น มาตรา ข้อ เลขที่ จำนวน ประมาณ ซึ่ง เพื่อ ตาม ต่อ
บน ใต้ แก่ แด่ สำหรับ ระหว่าง ตั้งแต่ จนถึง ด้าน ข้าง ทั้ง ทั้งหมด เกือบ ราว กว่า เพราะ เนื่องจาก ถ้า หาก แม้ แม้ว่า แต่ การ ความ ผู้ นาย นาง นางสาว ดร. พ.ศ. เช่น ได้แก่ ชื่อ อายุ เวลา ราคา จะ ไม่ กำลัง
""".split()) - {"ทั้งหมด", "กว่า"}
# A clause goes on with these at its start.
GO_ON = frozenset("""
และ หรือ ซึ่ง ที่ กับ ว่า โดย ของ ถึง น. พ.ศ. ๆ ฯลฯ เพราะ เพราะว่า เพื่อ เพื่อให้ เพื่อที่จะ จน จนกระทั่ง จนกว่า อัน คือ เช่น ได้แก่ แล้ว แล้วก็ ก็ จึง รวมทั้ง รวมถึง ตลอดจน พร้อมทั้ง พร้อมกับ อีกทั้ง ทั้งที่ โดยเฉพาะ กว่า ด้วย
""".split())
# Go on with the clause unless a predicate of their own stands in the same chunk.
PREPOSITION = frozenset("ใน จาก ตาม บน ใต้ สำหรับ ระหว่าง ตั้งแต่ แก่ ต่อ ด้าน ข้าง ริม ตรง แถว".split())
# Count what a number before them says.
CLASSIFIER = frozenset("บาท สตางค์ ดอลลาร์ ปี วัน เดือน สัปดาห์ นาที วินาที ชั่วโมง โมง คน ราย ครั้ง เมตร กิโลเมตร กิโลกรัม กรัม ลิตร ไร่ ตัว คัน หลัง เล่ม ใบ ลูก ดวง แห่ง ฉบับ ชิ้น อัน ชุด คู่ ข้อ เรื่อง องศา เปอร์เซ็นต์ ล้าน ล้านบาท แสน หมื่น พัน ร้อย ชั้น ขวด แก้ว จาน".split())
# A clause that starts with these waits for its main clause.
SUBORDINATE = frozenset("ถ้า ถ้าหาก หาก หากว่า เมื่อ แม้ แม้ว่า ถึงแม้ ถึงแม้ว่า เนื่องจาก ขณะที่ ในขณะที่ หลังจาก หลังจากที่ ก่อนที่ ตราบใดที่ พอ เพราะ".split())
# Open a new sentence wherever the one before is complete.
LINK = frozenset("ทั้งนี้ นอกจากนี้ นอกจากนั้น ดังนั้น อย่างไรก็ตาม อย่างไรก็ดี แต่ แต่ว่า เพราะฉะนั้น ต่อมา จากนั้น หลังจากนั้น ในที่สุด สุดท้าย ขณะเดียวกัน ในทางกลับกัน กล่าวคือ อนึ่ง สรุปแล้ว สำหรับเรื่องนี้ ด้วยเหตุนี้".split())
# Nouns that open a sentence of a ruling.
COURT = frozenset("ศาล ให้ คำร้อง คำขอ คำอุทธรณ์ คำฟ้องแย้ง คำฟ้อง จำนวน โจทก์ จำเลย ผู้ร้อง พยาน".split())
# Make a noun of the verb after them, or a clause of it that belongs to the noun before.
NOMINAL = frozenset("การ ความ ผู้ นัก ที่ ซึ่ง อัน เครื่อง ช่าง คำ ค่า น่า".split())
# Words in which others would be found.
NOUN = frozenset("""
บ้าน เมือง ประเทศ จังหวัด อำเภอ หมู่บ้าน ถนน ตลาด ร้าน ร้านค้า ร้านอาหาร โรงเรียน โรงพยาบาล โรงงาน โรงแรม มหาวิทยาลัย วัด สนามบิน สถานี ห้อง ห้องเรียน ห้องนอน ห้องน้ำ ห้องสมุด ที่ทำงาน ที่พัก ที่นั่ง ที่ดิน สวน ป่า ภูเขา ทะเล แม่น้ำ ชายหาด
พ่อ แม่ พี่ น้อง ลูกค้า ลูกชาย ลูกสาว เด็ก นักเรียน นักศึกษา ครู อาจารย์ หมอ แพทย์ พยาบาล ตำรวจ ทหาร คนขับ พนักงาน ผู้จัดการ ผู้ชาย ผู้หญิง ผู้ใหญ่ ผู้คน ประชาชน เพื่อน ชาวบ้าน ชาวนา รัฐมนตรี นายกรัฐมนตรี รัฐบาล บริษัท ธนาคาร องค์กร ทีม นักวิจัย นักวิทยาศาสตร์ นักท่องเที่ยว นักข่าว
แมว หมา สุนัข นก ปลา ไก่ หมู ช้าง วัว ควาย ต้นไม้ ดอกไม้ ผัก ผลไม้ ข้าว อาหาร น้ำ กาแฟ ชา นม ขนม ไข่ เนื้อ รถ รถไฟ รถยนต์ เครื่องบิน เรือ หนังสือ ปากกา โต๊ะ เก้าอี้ คอมพิวเตอร์ โทรทัศน์ ประตู หน้าต่าง เงิน เงินเดือน ราคา ค่าใช้จ่าย ค่าจ้าง
เวลา วันนี้ เมื่อวาน เมื่อวานนี้ พรุ่งนี้ ตอนเช้า ตอนเย็น ตอนนี้ ปีนี้ ปีที่แล้ว เดือนนี้ สัปดาห์หน้า เมื่อคืน เมื่อเช้า เมื่อก่อน คืนนี้ เช้า เย็น กลางคืน ฤดูหนาว วันหยุด วันเกิด อากาศ ฝน หิมะ ลม แดด พายุ น้ำท่วม ไฟไหม้ แผ่นดินไหว อุบัติเหตุ ข่าว ปัญหา โครงการ นโยบาย เศรษฐกิจ กฎหมาย เรื่อง ภาษา ภาพยนตร์ เพลง ดนตรี กีฬา ฟุตบอล
สัญญา คดี หมาย พิพาท ชั่วคราว ความเสียหาย คำสั่ง คำตอบ คำถาม คำพิพากษา คำให้การ คำแนะนำ คำเตือน ชีวิต สุขภาพ ยา โรค ไวรัส วัคซีน เทคโนโลยี ข้อมูล โทรศัพท์มือถือ อินเทอร์เน็ต เว็บไซต์ ที่ประชุม การแข่งขัน ความคิด ความสุข ความรัก ความรู้ ผลการวิจัย ตัวอย่าง รายงานข่าว ทำเล มาตรการ มาตรฐาน ไปรษณีย์ เป็นต้น
""".split())
# Stand before a given name of at most NAME letters, which a blank parts from the family name.
TITLE = frozenset("นาย นาง นางสาว เด็กชาย เด็กหญิง ดร. พลเอก พลตรี พันเอก ร้อยตรี".split())
NAME = 14
# Letters of a chunk from which on a listed noun or pronoun and an unlisted word can be a clause.
CLAUSE = 12
OPEN = LINK | COURT
WORDS = VERB | STATE | AUX | DEGREE | THIS | PRONOUN | FINAL | EXPECT | GO_ON | PREPOSITION | CLASSIFIER | SUBORDINATE | OPEN | NOMINAL | NOUN | TITLE
SUBJECT = NOUN | PRONOUN
LONGEST = max(map(len, WORDS))


def predicate(words: list[str] | tuple[str, ...]) -> bool:
    """Whether a verb of a run of words can be its predicate."""
    for i, w in enumerate(words):
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        if w in VERB and before not in NOMINAL:
            return True
        if w in STATE and before not in NOMINAL and (before in AUX or before in THIS or before in PRONOUN or after in DEGREE or after in FINAL):
            return True
    # A subject, then a word that isn't listed: its verb may be one of those missing here.
    return len(words) > 1 and words[0] in SUBJECT and words[1] not in WORDS and len(words[1]) > 1 and sum(map(len, words)) >= CLAUSE
