"""Fixed correction tables. They must be exactly these for right results; parsed by `orthoflow.sources.lexicon`."""

#: `[always wrong]` rows are corrected as they are; `[depends on meaning]` rows stay open for a scorer.
CONFUSABLES = """
[always wrong]
xử dụng => sử dụng
sử lý => xử lý
sử sự => xử sự
xúc tích => súc tích
sơ xài => sơ sài
sơ xuất => sơ suất
suất sắc => xuất sắc
sáng lạn => xán lạn
sáng lạng => xán lạn
xán lạng => xán lạn
đường xá => đường sá
cọ sát => cọ xát
xoay sở => xoay xở
câu truyện => câu chuyện
truyện trò => chuyện trò
chuyện ngắn => truyện ngắn
chân trọng => trân trọng
trân thành => chân thành
bắt trước => bắt chước
nhất chí => nhất trí
khúc triết => khúc chiết
trau truốt => trau chuốt
chau dồi => trau dồi
tựu chung => tựu trung
vô hình chung => vô hình trung
vô hình dung => vô hình trung
chăn trở => trăn trở
chải nghiệm => trải nghiệm
dấu diếm => giấu giếm
dấu giếm => giấu giếm
che dấu => che giấu
dành giật => giành giật
giành dụm => dành dụm
để giành => để dành
lãng mạng => lãng mạn
thái độ bàng quang => thái độ bàng quan
chuẩn đoán => chẩn đoán
sát nhập => sáp nhập
thăm quan => tham quan
chín mùi => chín muồi
điểm xuyến => điểm xuyết
vãng cảnh => vãn cảnh
nhận chức => nhậm chức
chỉnh chu => chỉn chu
buôn chải => bươn chải
bươn trải => bươn chải
kết cuộc => kết cục
sửa chửa => sửa chữa
xuất xắc => xuất sắc
tựu chung lại => tựu trung lại
bảng lĩnh => bản lĩnh
[depends on meaning]
chia xẻ | chia sẻ
dành cho | giành cho
dành lấy | giành lấy
dành chiến thắng | giành chiến thắng
dành được | giành được
giả thiết | giả thuyết
yếu điểm | điểm yếu
phong thanh | phong phanh
nề nếp | nền nếp
"""

#: A common typo and its known answers, most frequent first.
TYPOS = """
khôgn => không
ớc => ước | ác
môt => một | môn | mộc
măt => mắt | mặt | mật
nguời => người | ngươi
ngưoi => ngươi | người
đso => đó | sơ
đươc => được
đuợc => được
nhưgn => nhưng | những
săc => sắc
tôc => tộc | tốc
thôgn => thông
biêt => biết
hăc => hắc
khuyếch => khuếch
lứon => lớn
cuời => cười
duới => dưới
truợng => trượng | trưởng
trươc => trước
viêc => việc | viên
đưòng => đường
đựoc => được
chơt => chợt | chờ
nghạnh => ngạnh
ngưòi => người
tiéng => tiếng
vịđạo => vị đạo
bât => bất
băt => bắt
mắ => mắt
mặ => mặc | mặt | mà
trưóc => trước
trướ => trước
vât => vật
đă => đã
chỉếm => chiếm
côgn => công
diêt => diệt
găp => gặp
hoăc => hoặc | hoắc
hoặch => hoạch
kó => có
kông => không
lièn => liền
măc => mặc
ngoời => người | ngươi
nưuã => nữa
thuôc => thuộc
thuờng => thường
thậ => thật | thả | thận
tiêp => tiếp | tiên | tiêu
xuât => xuất
đôt => đột
biế => biết
chăc => chắc
dứoi => dưới
giảđại => giả đại
hêt => hết
hũu => hữu
hơp => hợp | hơi
khẳ => khả
lênn => lên
lưc => lực
muời => mười
mât => mất | mật
măy => may
mưoi => mươi
mẩt => mất
nguơi => ngươi
ngênh => nghênh
nhiiều => nhiều
nhâ => nhan | nhi | nhân
nhãnchi => nhãn chi
nhéch => nhếch
nhúch => nhúc
nhắ => nhắc | nhăm
noiư => nơi
noó => nói | nó
nẵ => gã | nã | đã
phôc => phốc
quyêt => quyết
rôt => rốt
rútt => rút
thưc => thực | thức
thượgn => thượng
tiép => tiếp
tnều => tiêu
truớc => trước
tâp => tâm | tập
tât => tất
uớc => ước
xuốgn => xuống
àny => này
đep => đẹp
đât => đất | đây
"""

BLOCK_TAGS = (
    "p div br h1 h2 h3 h4 h5 h6 li td th tr blockquote section article hr table ul ol dl dd dt figure figcaption "
    "aside body html head title meta link"
).split()
SKIPPED_TAGS = "script style code pre".split()
FORMAT_TAGS = "i b em strong span u s small big".split()
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}

#: Display names of the kinds of edit and of evidence.
KIND_NAMES = {
    "unicode": "Unicode",
    "spacing": "Khoảng trắng",
    "punctuation": "Dấu câu",
    "tone_mark": "Dấu thanh",
    "tone_style": "Kiểu đặt dấu",
    "bad_syllable": "Tiếng sai",
    "confusable": "Dễ nhầm",
    "glued": "Dính chữ",
}
EVIDENCE_NAMES = {
    "typo": "typo hay gặp",
    "cluster": "cụm tên riêng của sách",
    "compound": "từ ghép trong từ điển",
    "diacritic": "chỉ thêm một dấu phụ",
    "split": "hai tiếng dính liền",
}
#: Kinds that change style only.
STYLE_KINDS = ("spacing", "unicode", "punctuation", "tone_style")
CERTAINTY_RANK = {"sure": 0, "likely": 1, "doubtful": 2}
